"""Near-duplicate classes by order MinHash.

A text's words, in lower case (A-Z), form shingles of ``K`` words, each labelled with its occurrence so that repeats count.
A sketch takes the two labelled shingles with the smallest hashes and keeps them in text order; a band is two sketches.
Texts that share a band are candidates, and a banded alignment verifies them: common labelled shingles whose offsets differ
by no more than an accepted pair allows are chained in order, and chain / (a + b - chain) must reach ``threshold``.

Equal word sequences are one node, so copies never form pairs. A bucket's nodes are first compared with its head, the node
whose buckets are largest, which of an original and its edited copies is the original; links make components. Then every
pair of a bucket whose ends still lie in two components is tested, bucket by bucket, so no link between candidates is lost:
in buckets of at most ``SMALL`` nodes as rows of pairs, in larger ones block against block. There the nodes outside the
component that is the bucket's largest meet all its nodes of a size that a link allows (classes of sizes in steps of the
threshold), first ``KIN`` of that component as pairs, then blocks of at most ``PART`` nodes or ``PART_WORDS`` words, which are packed before they are copied: a task
gets two blocks, counts common shingles through an inverted index of one of them, aligns only pairs that share enough, and
returns a spanning set of links. So no large bucket emits its pairs, no task grows with the bucket, and the largest
component, such as thousands of edited copies of one text, is never compared with itself.

Defined results: a row for each row of the input. Null texts and those without words are classes of their own; a text with
fewer than K words is one shingle; class_id is the smallest doc_id of the class (null if all are null); repeated rows are
members like others; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, components, read, saved, text_key

K, BANDS, SKETCHES, THRESHOLD = 5, 16, 2, 0.8
MAX_WORDS, BLOCK, SMALL, KIN, PART, PART_WORDS, SALT_ROWS, SALTS = 400_000, 16_384, 32, 4, 256, 1_000_000, 512, 16
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(7).integers(1, 2**63, BANDS * SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = "rid long, doc_id {}, k1 long, k2 long, n1 long, n2 long, bands array<long>, words binary"


class Hashes(dict):
    """Hashes of words, filled as words appear."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the shingles, in text order; equal shingles differ by their occurrence."""
    w = words.astype(np.uint64)
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(min(len(w), k)))
    for j in range(min(k, len(w))):
        h = mixed(h ^ w[j : j + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.flatnonzero(s[1:] == s[:-1])
    if len(again):
        starts = np.concatenate([[True], s[1:] != s[:-1]])
        place = np.arange(n)
        occurrence = place - np.maximum.accumulate(np.where(starts, place, 0))
        label = np.empty(n, np.uint64)
        label[order] = occurrence
        h = np.where(label > 0, mixed(h + label * FACTORS[0]), h)
    return h


def sketch(h: np.ndarray, bands: int = BANDS, sketches: int = SKETCHES) -> list[int]:
    """A hash for each band: of the two smallest shingles under each of its functions, in text order."""
    factors = FACTORS[: bands * sketches, None]
    best, where = [], []
    for i in range(0, len(h), BLOCK):
        v = h[i : i + BLOCK] * factors
        for _ in range(2):
            at = v.argmin(1)
            best.append(np.take_along_axis(v, at[:, None], 1)[:, 0])
            where.append(at + i)
            v[np.arange(len(v)), at] = np.uint64(2**64 - 1)
    best, where = np.array(best), np.array(where)
    if len(best) > 2:
        two = np.argsort(best, axis=0, kind="stable")[:2]
        where = np.take_along_axis(where, two, 0)
    where.sort(axis=0)
    pair = mixed(h[where[0]]) * MIX + h[where[1]] + np.arange(len(FACTORS[: bands * sketches]), dtype=np.uint64)
    out = np.zeros(bands, np.uint64)
    for j in range(sketches):
        out = mixed(out + pair[j::sketches])
    return out.view(np.int64).tolist()


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rid = Hashes(), TaskContext.get().partitionId() << 33
        with np.errstate(over="ignore"):
            for batch in batches:
                for start, texts in chunks(batch):
                    if len(hashes) > MAX_WORDS:
                        hashes.clear()
                    rows = []
                    for t in texts:
                        words = t.lower().split() if t else []
                        if words:
                            w = np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))
                            d = xxhash.xxh128_digest(b" ".join(words))
                            n1, n2 = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                            rows.append((rid, n1, n2, sketch(shingles(w)), w.tobytes()))
                        else:
                            rows.append((rid, rid, 0, [], b""))
                        rid += 1
                    part = batch.slice(start, len(texts))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([cols[0], part.column("doc_id"), part.column("k1"), part.column("k2"), *cols[1:]], names=["rid", "doc_id", "k1", "k2", "n1", "n2", "bands", "words"])

    keyed = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text"))
    return saved(keyed.mapInArrow(run, SKETCH.format(docs.schema[doc_id].dataType.simpleString())), "sketches")


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Of two lists of labelled shingles: the chain's share, or 0 if it cannot reach the threshold."""
    n = len(a) + len(b)
    least = threshold / (1 + threshold) * n  # of a chain that suffices
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least - 1e-9:
        return 0.0
    band = (1 - threshold) * (n - least) + 1
    order = np.argsort(i)
    i, j = i[order], j[order]
    ends: list[int] = []
    for x in j[np.abs(i - j) <= band].tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends) / (n - len(ends))


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those that are similar. words: (rid, words)."""
    left = pairs.join(words.withColumnsRenamed({"rid": "b", "words": "wb"}), "b")
    both = left.join(words.withColumnsRenamed({"rid": "a", "words": "wa"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cached = None, None
        with np.errstate(over="ignore"):
            for batch in batches:
                keep = []
                for a, x, y in zip(batch.column("a").to_pylist(), batch.column("wa"), batch.column("wb"), strict=True):
                    if a != last:
                        last, cached = a, shingles(np.frombuffer(x.as_py(), np.uint32))
                    keep.append(similarity(cached, shingles(np.frombuffer(y.as_py(), np.uint32)), threshold) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def met_in_blocks(left: list[tuple], right: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) between two blocks of (node, label, outside, words) that join all labels which links between them join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    mine = [shingles(np.frombuffer(w, np.uint32)) for *_, w in left]
    sizes = np.array([len(x) for x in mine])
    tokens, owner = np.concatenate(mine), np.repeat(np.arange(len(mine)), sizes)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    known, first, times = np.unique(tokens[order], return_index=True, return_counts=True)
    out = []
    for node, label, outside, w in right:
        s = shingles(np.frombuffer(w, np.uint32))
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        at = at[known[at] == s]
        n = times[at]
        place = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
        common = np.bincount(owner[place], minlength=len(mine))
        for i in np.flatnonzero(common >= threshold / (1 + threshold) * (sizes + len(s)) - 1e-9).tolist():
            other, mark, *_ = left[i]
            if (outside and other >= node) or root(mark) == root(label):
                continue  # two nodes outside meet once
            if similarity(mine[i], s, threshold) >= threshold:
                parent[root(mark)] = root(label)
                out.append((min(node, other), max(node, other)))
    return out


def dealt(nodes: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(band, h, c, i, j, mine, block): each two blocks that meet, as two rows. nodes: (band, h, node, label, outside).

    Nodes meet their words before they are packed, at most four times each; only whole blocks are copied.
    """
    cell = ["band", "h", "c"]
    size = F.floor(F.log(F.greatest(F.col("bytes") / 4 - (K - 1), F.lit(1.0))) / F.lit(-1.0001 * math.log(threshold)))
    sized = saved(nodes.join(words.select(F.col("rid").alias("node"), F.octet_length("words").alias("bytes")), "node").withColumn("c", size), "sized")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("bytes") / F.lit(4 * PART_WORDS))).cast("int")
    left = sized.filter("outside").select(*cell, "node", "label", "outside")
    right = sized.select("band", "h", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), "node", "label", "outside", "bytes")
    lefts = sized.filter("outside").groupBy(*cell).agg(parts.alias("n"))
    row = F.xxhash64("node", F.lit("block"))
    salt, salts = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left, right = left.withColumn("s", salt), right.withColumn("s", salt)
    rights = right.join(lefts.select(*cell, salts.alias("s")), [*cell, "s"], "left_semi").groupBy(*cell).agg(parts.alias("m"))
    cells = saved(lefts.join(rights, cell), "cells").withColumn("s", salts)
    own = ["node", "label", "outside"]
    mine = left.join(cells, [*cell, "s"]).select(*cell, *own, F.lit(True).alias("mine"), F.pmod(row, "n").cast("int").alias("own"), F.col("m").alias("others"))
    theirs = right.join(cells, [*cell, "s"]).select(*cell, *own, F.lit(False).alias("mine"), F.pmod(row, "m").cast("int").alias("own"), F.col("n").alias("others"))

    def pack(rows: pa.Table) -> pa.Table:
        block = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in (*own, "words")], names=[*own, "words"])
        return rows.slice(0, 1).select([*cell, "mine", "own", "others"]).append_column("block", pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), block))

    kinds = {f.name: f.dataType.simpleString() for f in mine.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*cell, "mine", "own", "others")) + ", block array<struct<node: bigint, label: bigint, outside: boolean, words: binary>>"
    blocks = mine.unionByName(theirs).join(words.withColumnRenamed("rid", "node"), "node").groupBy(*cell, "mine", "own").applyInArrow(pack, schema)
    copies = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return copies.select(*cell, F.when(F.col("mine"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("mine"), F.col("other")).otherwise(F.col("own")).alias("j"), "mine", "block")


def blocked(nodes: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of large buckets between nodes outside and all others. nodes: (band, h, node, label, outside)."""

    def solve(rows: pa.Table) -> pa.Table:
        two = {m: [tuple(x.values()) for x in block] for m, block in zip(rows["mine"].to_pylist(), rows["block"].to_pylist(), strict=True)}
        with np.errstate(over="ignore"):
            links = met_in_blocks(two[True], two[False], threshold) if len(two) == 2 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return dealt(nodes, words, threshold).groupBy("band", "h", "c", "i", "j").applyInArrow(solve, "a long, b long")


def linked(buckets: DataFrame, words: DataFrame, threshold: float) -> DataFrame | None:
    """Verified links (a, b). buckets: (band, h, node, n, w), n nodes to a bucket, w the sizes of the node's buckets together."""
    key = ["band", "h"]
    if buckets.isEmpty():
        return None
    pair = [F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")]
    # a large bucket is dealt to n / SALT_ROWS tasks
    spread = F.floor((F.col("n") - 1) / SALT_ROWS).cast("int")
    heads = buckets.groupBy(*key).agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("head"), F.first("n").alias("n")).withColumn("s", F.explode(F.sequence(F.lit(0), spread))).drop("n")
    headed = saved(buckets.withColumn("s", F.pmod(F.xxhash64("node"), spread + 1).cast("int")).join(heads, [*key, "s"]).drop("s"), "headed")
    tested = saved(headed.filter("node <> head").select(*pair).distinct(), "pairs")
    links = saved(verified(tested, words, threshold), "links")
    labels = components(links)

    def tagged(df: DataFrame) -> DataFrame:
        """Nodes and heads with the labels of their components: one table that all comparisons read."""
        own, of = labels.select("node", F.col("label").alias("l")), labels.select(F.col("node").alias("head"), F.col("label").alias("m"))
        met = df.join(own, "node", "left").join(of, "head", "left")
        return saved(met.select(*key, "node", "head", "n", F.coalesce("l", "node").alias("label"), F.coalesce("m", "head").alias("head_label")), "tagged")

    nodes = tagged(headed)
    few, many = nodes.filter(F.col("n").between(3, SMALL)), nodes.filter(F.col("n") > SMALL)
    other = few.select(*key, F.col("node").alias("b"), F.col("label").alias("l"))
    pairs = few.join(other, [few["band"] == other["band"], few["h"] == other["h"], F.col("node") < F.col("b"), F.col("label") != F.col("l")]).select(F.col("node").alias("a"), "b")
    rest = many.filter("label <> head_label")
    order = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("node", "band"), "node"))
    kin = many.filter("label = head_label and node <> head").withColumn("i", order).filter(F.col("i") <= KIN).select(*key, F.col("node").alias("head"), F.explode(F.sequence(F.lit(0), spread)).alias("s"))
    pairs = pairs.unionByName(rest.drop("head").withColumn("s", F.pmod(F.xxhash64("node"), spread + 1).cast("int")).join(kin, [*key, "s"]).select(*pair))
    new = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(saved(verified(new, words, threshold), "links"))
    labels = components(links)
    many = tagged(many.drop("label", "head_label")).select(*key, "node", "n", "label")
    # outside: not of the component that holds most of the bucket
    sizes = many.groupBy(*key, "label").agg(F.count("*").alias("k"))
    most = sizes.groupBy(*key).agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("apart"), F.sum("k").alias("n")).filter("apart > 1")
    most = most.withColumn("s", F.explode(F.sequence(F.lit(0), spread))).drop("n", "apart")
    many = many.withColumn("s", F.pmod(F.xxhash64("node"), spread + 1).cast("int"))
    still = saved(many.join(most, [*key, "s"]).select(*key, "node", "label", (F.col("label") != F.col("most")).alias("outside")), "open")
    return links if still.isEmpty() else links.unionByName(saved(blocked(still, words, threshold), "links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k1, k2, rid, label, class_id, first): k1 and k2 hash the text; first marks a row of each class, and its repeats."""
    rows = sketched(docs, doc_id, text)
    nodes = saved(rows.groupBy("n1", "n2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low")), "nodes")
    reps = rows.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi")
    banded = reps.filter(F.size("bands") > 0).select("rid", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1")
    met = saved(banded.join(shared, ["band", "h"]).select("band", "h", F.col("rid").alias("node"), "n"), "met")
    buckets = saved(met.join(met.groupBy("node").agg(F.sum("n").alias("w")), "node"), "buckets")
    links = linked(buckets, saved(rows.select("rid", "words").hint("shuffle_merge").join(buckets.select(F.col("node").alias("rid")).distinct(), "rid", "left_semi"), "words"), threshold)
    labels = None if links is None else components(links)
    if labels is None:
        labels = nodes.limit(0).select("node", F.col("node").alias("label"))
    joined = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = joined.groupBy("label").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("f"))
    named = joined.join(low, "label").select("n1", "n2", "label", "class_id", F.col("f.node").alias("first_node"), F.col("f.low").alias("first_low"), "node")
    out = rows.select("rid", "doc_id", "k1", "k2", "n1", "n2").join(named, ["n1", "n2"])
    first = (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_low"))
    return out.select("doc_id", "k1", "k2", "rid", "label", "class_id", first.alias("first"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id."""
    kept = saved(classes(docs, doc_id, text, threshold).filter("first").groupBy("label").agg(F.min_by(F.struct("doc_id", "k1", "k2"), "rid").alias("x")), "kept")
    kept = kept.select(F.col("x.doc_id").alias("__id"), F.col("x.k1").alias("__a"), F.col("x.k2").alias("__b"))
    a, b = text_key(F.col(text))
    keyed = docs.withColumns({"__1": a, "__2": b})
    match = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__1") == F.col("__a")) & (F.col("__2") == F.col("__b"))
    return keyed.join(kept, match, "left_semi").dropDuplicates([doc_id, "__1", "__2"]).drop("__1", "__2")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")
