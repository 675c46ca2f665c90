"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation at their ends and their case; those with a digit become the placeholder <n>, units after a
number <u>, capitalised words (not all capitals) within a sentence <p>. Windows of ``width`` such words (at least ``min_literals`` of them no
placeholders) are hash-joined with those of the benchmark, on hash and template. The windows of a document and an item at
one offset form an alignment; its windows count if their slots are consistent: each value of the item's in them has one
value of the document's in the whole alignment, though two of the item's may share one. Windows that hold a contradicted value
do not count, the others of the alignment do. So changed numbers, names and units are caught. A document leaks an item if the counted windows cover ``min_cover`` of the item's.

A window with fewer than ``min_literals`` plain words says too little as a template, so it is matched by its exact words,
values included; so arithmetic and very short items are found where they are copied. Where at least half of an item's windows
are templates, their cover alone suffices.

Items of one text are one item until the end. A leak needs a number of an item's windows, so at least one outside the fewer
ones that most items share: only by those rarer windows do documents and items meet, and only such pairs meet in all windows.
So an instruction that many items and documents begin with makes no pairs, unless it covers enough of the items by itself.

The benchmark's window hashes go to the tasks as a filter while there are at most ``MAX_WINDOWS``; beyond that every
window of the documents takes part in the join.

Defined results: null and empty texts leak nothing, as items they match nothing; items shorter than the width are one
window of their own length, and those of fewer than ``MIN_WORDS`` words, since any text may hold them, are met by documents
of just these words; rows
are told apart by id and text, so a null or repeated id is no trouble and repeated rows are treated alike; a very long text
is read whole, and what it repeats counts once; empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, read, saved, text_key

WIDTH, MIN_LITERALS, MIN_WORDS, MIN_COVER, MAX_WINDOWS = 8, 5, 3, 0.3, 4_000_000
MAX_TYPES, SALT, EXACT = 300_000, 16, "="  # the last begins a window of exact words; words never begin with it
#: Units that count as such after a number.
UNITS = "% mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years dollars euros cents usd eur mph kmh degrees meters metres miles feet inches grams kilograms liters litres".split()
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
MARK = {NUMBER: "<n>", NAME: "<p>", UNIT: "<u>"}
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Types:
    """What is known of each distinct word, filled as words appear."""

    def __init__(self):
        self.of, self.kind, self.code, self.ends, self.word = {}, array("b"), array("Q"), array("b"), []

    def __getitem__(self, raw: bytes) -> int:
        found = self.of.get(raw)
        if found is None:
            found = self.of[raw] = len(self.word)
            text = raw.decode()
            bare = EDGE.sub("", text) or ("%" if text == "%" else "")
            low = bare.lower()
            self.kind.append(NOTHING if not bare else NUMBER if any(c.isdigit() for c in bare) else UNIT if low in UNITS else NAME if bare[0].isupper() and not bare.isupper() else LITERAL)
            self.code.append(xxhash.xxh64_intdigest(low))
            self.ends.append(text[-1] in ".!?:")
            self.word.append(low)
        return found


def canonical(texts: list[bytes | None], types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, without empty ones: text number, type number, kind, code and code of the exact word."""
    ids, counts = [], []
    for t in texts:
        words = t.split() if t else []
        ids.append(np.fromiter(map(types.__getitem__, words), np.int32, len(words)))
        counts.append(len(words))
    ids, owner = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.repeat(np.arange(len(texts)), counts)
    kind, ends = np.array(types.kind, np.int8)[ids], np.array(types.ends, bool)[ids]
    starts = np.ones(len(ids), bool)
    starts[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    keep = kind != NOTHING
    ids, owner, kind, starts = ids[keep], owner[keep], kind[keep], starts[keep]
    after = np.zeros(len(ids), bool)
    after[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    kind = np.where((kind == NAME) & starts | (kind == UNIT) & ~after, LITERAL, kind)
    exact = np.array(types.code, np.uint64)[ids]
    code = exact.copy()
    for k in MARK:
        code[kind == k] = np.uint64(k)
    return owner, ids, kind, code, exact


def rolled(code: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that begin at some places."""
    h = np.full(len(at), np.uint64(width))
    with np.errstate(over="ignore"):
        for j in range(width):
            h = (h ^ code[at + j]) * PRIME
            h ^= h >> np.uint64(29)
    return h


def windows(owner: np.ndarray, kind: np.ndarray, code: np.ndarray, exact: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the windows within one text, and whether each is a template or stands for its exact words."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    form = plain[at + width] - plain[at] >= least
    h = np.empty(len(at), np.uint64)
    h[form] = rolled(code, at[form], width)
    h[~form] = ~rolled(exact, at[~form], width)
    return at, h, form


HITS = "id {}, k1 long, k2 long, hash long, template string, pos int, slots array<string>, words int"


def template_windows(df: DataFrame, widths: list[int] | None, wanted: np.ndarray | None, least: int, width: int = WIDTH) -> DataFrame:
    """The windows of each row of df (id, k1, k2, text): of all given widths, or of the row's own (at most `width`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types()
        if wanted is not None:
            probe = np.zeros(1 << 22, bool)
            probe[(wanted >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            keys = [batch.column(c) for c in ("id", "k1", "k2")]
            for start, texts in chunks(batch):
                if len(types.word) > MAX_TYPES:
                    types = Types()
                owner, ids, kind, code, exact = canonical(texts, types)
                length = np.bincount(owner, minlength=len(texts))
                first = np.concatenate([[0], np.cumsum(length)])
                rows = []
                for w in widths or sorted({int(min(width, n)) for n in length if n}):
                    at, h, form = windows(owner, kind, code, exact, w, least)
                    if widths is None:
                        fits = np.minimum(length[owner[at]], width) == w
                        at, h, form = at[fits], h[fits], form[fits]
                    if w < MIN_WORDS:
                        alone = length[owner[at]] == w
                        at, h, form = at[alone], h[alone], form[alone]
                    if wanted is not None and len(wanted):
                        near = np.flatnonzero(probe[(h >> np.uint64(42)).astype(np.int64)])
                        place = np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)
                        near = near[wanted[place] == h[near]]
                        at, h, form = at[near], h[near], form[near]
                    for i, x, shaped in zip(at.tolist(), h.view(np.int64).tolist(), form.tolist(), strict=True):
                        ks, ws = kind[i : i + w].tolist() if shaped else [LITERAL] * w, [types.word[t] for t in ids[i : i + w].tolist()]
                        d = int(owner[i])
                        rows.append((d + start, x, ("" if shaped else EXACT) + " ".join(MARK.get(k, v) for k, v in zip(ks, ws, strict=True)), i - int(first[d]), [f"{MARK[k]}{v}" for k, v in zip(ks, ws, strict=True) if k in MARK], int(length[d])))
                if rows:
                    who, *rest = zip(*rows, strict=True)
                    who = pa.array(who)
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32())
                    yield pa.RecordBatch.from_arrays([k.take(who) for k in keys] + [pa.array(c, k) for c, k in zip(rest, kinds, strict=True)], names=["id", "k1", "k2", "hash", "template", "pos", "slots", "words"])

    return df.mapInArrow(run, HITS.format(df.schema["id"].dataType.simpleString()))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", width: int = WIDTH, min_literals: int = MIN_LITERALS, min_cover: float = MIN_COVER, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, k1, k2, item_id, matched, of): documents, with the hashes of their texts, and the items that they leak."""
    members = benchmark.select(F.col(item_id).alias("item_id"), *(c.alias(n) for c, n in zip(text_key(F.col(item)), ("i1", "i2"), strict=True))).distinct()
    items = benchmark.select(*text_key(F.col(item)), F.col(item).alias("text")).dropDuplicates(["k1", "k2"]).select(F.col("k1").alias("id"), "k1", "k2", "text")
    bench = saved(template_windows(items, None, None, min_literals, width), "items")
    count = bench.count()
    widths = sorted(r[0] for r in bench.select(F.least("words", F.lit(width)).alias("w")).distinct().collect()) or [width]
    wanted = np.unique(bench.select("hash").distinct().toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64)) if count <= max_windows else None
    shaped = ~F.col("template").startswith(EXACT)
    of = bench.groupBy(F.col("k1").alias("i1"), F.col("k2").alias("i2")).agg(F.count("*").alias("of"), F.count(F.when(shaped, 1)).alias("of_shaped"))
    need = F.ceil(F.when(2 * F.col("of_shaped") >= F.col("of"), F.least("of", "of_shaped")).otherwise(F.col("of")) * F.lit(float(min_cover)))
    keyed = docs.select(F.col(doc_id).alias("id"), *text_key(F.col(text)), F.col(text).alias("text"))
    hits = saved(template_windows(keyed, widths, wanted, min_literals, width), "hits").withColumnsRenamed({"id": "doc_id", "slots": "d_slots"}).drop("words")
    its = bench.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "hash", "template", F.col("pos").alias("at"), "slots")
    doc, key = ["doc_id", "k1", "k2"], ["i1", "i2"]
    held = its.join(its.groupBy("hash", "template").agg(F.countDistinct(*key).alias("items")), ["hash", "template"]).join(of, key)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("items"), "at"))
    rare = held.withColumn("place", place).filter(F.col("place") >= need).select(*key, "hash", "template").distinct()
    salted = hits.select(*doc, "hash", "template").distinct().withColumn("s", F.pmod(F.xxhash64(*doc), F.lit(SALT)).cast("int"))
    pairs = salted.join(rare.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["hash", "template", "s"]).select(*doc, *key).distinct()
    asked, found = pairs.join(its, key).alias("a"), hits.alias("h")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*doc, "hash", "template")]
    met = asked.join(found, same).select(*(f"a.{c}" for c in (*doc, *key, "template", "at", "slots")), "h.d_slots", (F.col("h.pos") - F.col("a.at")).alias("offset"))
    group = doc + key
    met = met.withColumn("pairs", F.arrays_zip("slots", "d_slots"))
    lines = met.groupBy(*group, "offset").agg(F.collect_set(F.struct("at", "slots", shaped.alias("shaped"))).alias("wins"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.col("pairs.slots")
    torn = F.when(F.size(F.array_distinct(values)) < F.size("pairs"), F.filter(F.array_distinct(values), lambda v: F.size(F.filter("pairs", lambda p: p["slots"] == v)) > 1)).otherwise(F.array().cast("array<string>"))
    sound = lines.withColumn("torn", torn).select(*group, F.transform(F.filter("wins", lambda w: ~F.arrays_overlap(w["slots"], F.col("torn"))), lambda w: F.struct(w["at"].alias("at"), w["shaped"].alias("shaped"))).alias("x"))
    matched = sound.select(*group, F.explode("x").alias("x")).groupBy(*group).agg(F.countDistinct("x.at").alias("matched"), F.countDistinct(F.when(F.col("x.shaped"), F.col("x.at"))).alias("shaped"))
    covered = (F.col("matched") >= min_cover * F.col("of")) | ((2 * F.col("of_shaped") >= F.col("of")) & (F.col("shaped") >= min_cover * F.col("of_shaped")))
    return matched.join(of, key).filter(covered).join(members, key).select(*doc, "item_id", F.col("matched").cast("long").alias("matched"), F.col("of").cast("long").alias("of"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """docs without the rows that leak an item."""
    bad = saved(leaks(docs, benchmark, doc_id, text, **kw).select(F.col("doc_id").alias("__id"), F.col("k1").alias("__a"), F.col("k2").alias("__b")).distinct(), "leaks")
    a, b = text_key(F.col(text))
    return docs.withColumns({"__1": a, "__2": b}).join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__1") == F.col("__a")) & (F.col("__2") == F.col("__b")), "left_anti").drop("__1", "__2")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, read(spark, sf_dir, "benchmark")).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("of").alias("windows"))
