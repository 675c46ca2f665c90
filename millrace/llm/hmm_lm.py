"""A hidden Markov language model: Baum-Welch over all training documents, exact scaled forward scores for all documents.

Words are those of the text with A-Z lowered, and an end token closes each text. The most frequent words (``head`` at most)
are symbols of their own; all other words share a tail class, which a state emits as one symbol and which is then
split by the words' smoothed training counts. These counts stay a table: words of the tail meet it in a join, and the sum of
their logarithms is added to the forward recursion's result, so nothing is cut off. Two such symbols are the tail of plain
words and that of words with other bytes than a-z, so that a state may tell them apart.

Baum-Welch: each task runs scaled forward and backward recursions over its documents, in step over many documents at once,
and returns expected counts by block of symbols, which are summed by block. Turns over a bounded sample of documents
(``sample_docs``, for a start only) are followed by ``turns`` over all training documents. What is collected is the model
itself, states x (head + 3) numbers. Emissions are interpolated with the symbols' overall shares, so no text has
probability 0.

The base score is a smoothed unigram: counts of the head travel with the model, those of the tail come from the join.

Defined results: null and empty texts consist of the end token; a document is held out if crc32 of its id as text (null: of
the empty text) mod 5 is 1; repeated rows are scored alike; without training documents N and V are 0 and every token has an
equal share; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, chunks, read, saved

STATES, HEAD, TURNS, SAMPLE_TURNS, SAMPLE_DOCS = 8, 65_536, 2, 8, 2_000
MIX, BLOCK, FLUSH, FAN = 0.02, 2_048, 400_000, 64
LANES = 500_000  # tokens worked on at a time


def tail_class(word: bytes) -> int:
    """0: a to z and nothing else; 1: anything else."""
    return 0 if word.isalpha() else 1


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @property
    def states(self) -> int:
        return len(self.start)


def mixed(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Emission probabilities (symbols x states) from counts, interpolated with overall shares."""
    total = counts.sum(0)
    return (1 - MIX) * counts / np.where(total > 0, total, 1) + np.where(total > 0, MIX, 1) * share[:, None]


def lanes(docs: list[np.ndarray], size: int = LANES) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of documents, longest first: (places, symbols by step, number of documents that reach each step)."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    at = 0
    while at < len(order):
        some, total = [], 0
        while at < len(order) and (not some or total + len(docs[order[at]]) <= size):
            some.append(order[at])
            total += len(docs[order[at]])
            at += 1
        lengths = np.array([len(docs[i]) for i in some])
        reach = len(some) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        step = np.concatenate([np.arange(n) for n in lengths])
        first = np.concatenate([[0], np.cumsum(reach)])
        lane = np.repeat(np.arange(len(some)), lengths)
        symbols = np.empty(total, np.int32)
        symbols[first[step] + lane] = np.concatenate([docs[i] for i in some])
        yield some, symbols, first


def forward(model: Model, symbols: np.ndarray, first: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log10 likelihood of each lane; the scaled forward variables and scales where they are kept."""
    n = first[1]
    out, alphas, scales = np.zeros(n), np.empty((len(symbols), model.states)) if keep else None, np.empty(len(symbols)) if keep else None
    a = np.repeat(model.start[None, :], n, 0)
    for t in range(len(first) - 1):
        lo, hi = first[t], first[t + 1]
        a = a[: hi - lo] if t == 0 else a[: hi - lo] @ model.move
        a = a * model.emit[symbols[lo:hi]]
        c = a.sum(1)
        a = a / c[:, None]
        out[: hi - lo] += np.log10(c)
        if keep:
            alphas[lo:hi], scales[lo:hi] = a, c
    return out, alphas, scales


def expected(model: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions."""
    _, alphas, scales = forward(model, symbols, first, True)
    move = np.zeros_like(model.move)
    beta = np.ones((first[1], model.states))
    for t in reversed(range(len(first) - 1)):
        lo, hi = first[t], first[t + 1]
        if t + 2 < len(first):
            nlo, nhi = hi, first[t + 2]
            k = nhi - nlo
            right = model.emit[symbols[nlo:nhi]] * beta[:k] / scales[nlo:nhi, None]
            move += alphas[lo : lo + k].T @ right
            beta[:k] = right @ model.move.T
        gamma = alphas[lo:hi] * beta[: hi - lo]
        alphas[lo:hi] = gamma / gamma.sum(1)[:, None]
    emit = np.stack([np.bincount(symbols, alphas[:, s], len(model.emit)) for s in range(model.states)], 1)
    return alphas[: first[1]].sum(0), move * model.move, emit


def reestimated(corpus: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch turn, and the tokens it saw. corpus: (symbols array<int>)."""
    k, v = model.states, len(model.emit)
    sent = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, move, emit, start = sent.value, np.zeros((k, k)), np.zeros((v, k)), np.zeros(k)
        for batch in batches:
            docs, held = [], 0
            for x in [*batch.column("symbols"), None]:
                if x is not None:
                    docs.append(x.values.to_numpy(zero_copy_only=False))
                    held += len(docs[-1])
                if docs and (x is None or held > LANES):
                    for _, symbols, first in lanes(docs):
                        s, mv, e = expected(m, symbols, first)
                        start += s
                        move += mv
                        emit += e
                    docs, held = [], 0
        parts = [(-1, np.concatenate([start[None], move]).ravel())] + [(i // BLOCK, emit[i : i + BLOCK].ravel()) for i in range(0, v, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.list_(pa.float64()))], names=["block", "x"])

    def total(part):
        return pa.table({"block": part["block"][:1], "salt": part["salt"][:1], "x": pa.array([np.sum([x.values.to_numpy() for x in part["x"]], axis=0)], pa.list_(pa.float64()))})

    # sums of sums: a block's parts, one from each task, meet in groups of FAN, then those sums meet
    parts, schema = corpus.mapInArrow(run, "block int, x array<double>").withColumn("salt", F.spark_partition_id()), "block int, salt int, x array<double>"
    sums = parts.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("block", "salt").applyInArrow(total, schema)
    got = {r["block"]: np.array(r["x"]) for r in sums.groupBy("block").applyInArrow(total, schema).collect()}  # the model's size
    if not got:
        return model, 0.0
    head = got[-1].reshape(k + 1, k) + 1e-3
    emit = np.concatenate([got[i].reshape(-1, k) for i in range(len(got) - 1)])
    return Model(head[0] / head[0].sum(), head[1:] / head[1:].sum(1)[:, None], mixed(emit, share)), float(emit.sum())


def first_guess(docs: list[np.ndarray], share: np.ndarray, states: int) -> Model:
    """States start at documents of the sample that have little in common; they rarely change within a text."""
    some = [d for d in docs if len(d) >= 30][:400]
    rng = np.random.default_rng(5)
    seeds, reached = [], None
    bags = [np.unique(d, return_counts=True) for d in some]
    weight = -np.log(np.maximum(share, 1e-12))
    for _ in range(min(states, len(some))):
        if reached is None:
            pick = 0
        else:
            near = [float((c * weight[w] * reached[w]).sum() / (c * weight[w]).sum()) for w, c in bags]
            pick = int(np.argmin(near))
        mark = np.zeros(len(share))
        mark[some[pick]] = 1
        reached = mark if reached is None else np.maximum(reached, mark)
        seeds.append(some[pick])
    emit = np.repeat(share[:, None], states, 1) * rng.uniform(0.8, 1.2, (len(share), states))
    for s, d in enumerate(seeds):
        emit[:, s] = 0.5 * emit[:, s] / emit[:, s].sum() + 0.5 * np.bincount(d, minlength=len(share)) / len(d)
    stay = 0.95 if states > 1 else 1.0
    move = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(move, stay)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def word_counts(keyed: DataFrame) -> DataFrame:
    """(word binary, c) over the training documents, without the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for _, texts in chunks(batch):
                for t in texts:
                    seen.update((t or b"").lower().split())
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return keyed.filter("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, head: int) -> list:
    """The words whose counts are above the lowest limit that leaves at most `head` of them; limits are 64 to a power of two."""
    step = F.floor(F.log2("c") * 64).cast("int")
    room, least = head, None
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # 64 rows for each power of two
        if r["count"] > room:
            break
        room, least = room - r["count"], r["s"]
    return [] if least is None else sorted(counts.filter(step >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


ENCODED = "rid long, doc_id {}, held_out boolean, n_tokens long, head_known long, base double, symbols array<int>, tail array<struct<w: binary, k: int, n: int>>"


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, head: int = HEAD, turns: int = TURNS, sample_turns: int = SAMPLE_TURNS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), (crc % 5 == 1).alias("held_out"), F.col(text).alias("text"))
    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    counts = saved(word_counts(keyed), "counts")
    kind = F.when(F.col("word").cast("string").rlike("^[A-Za-z]+$"), 0).otherwise(1)
    words, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = keyed.filter("not held_out").count()
    n, v = words + ends, v + (ends > 0)
    top = head_words(counts, head)
    place, count = {bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r["c"] for r in top] + [ends], float)
    end, tail0 = len(top), len(top) + 1
    whole = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    tails = []
    for k in (0, 1):
        mine = [r["c"] for r in top if tail_class(bytes(r["word"])) == k]
        c, types = whole.get(k, (0, 0))
        tails.append((float(c - sum(mine)), types - len(mine)))
    share = np.array([*count, *(c for c, _ in tails)]) + 0.5
    share /= share.sum()
    scale = n + 0.5 * (v + 1)
    base_head = np.log10((count + 0.5) / scale)
    sent = keyed.sparkSession.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, where = TaskContext.get().partitionId() << 33, sent.value
        for batch in batches:
            for first, texts in chunks(batch):
                rows = []
                for t in texts:
                    words = (t or b"").lower().split()
                    ids = np.fromiter((where.get(w, -1) for w in words), np.int32, len(words))
                    rare = np.flatnonzero(ids < 0)
                    mine: Counter = Counter(words[i] for i in rare.tolist())
                    ids[rare] = [tail0 + tail_class(words[i]) for i in rare.tolist()]
                    ids = np.append(ids, end).astype(np.int32)
                    known = len(words) - len(rare) + (ends > 0)
                    rows.append((rid, len(words) + 1, known, float(base_head[ids[ids <= end]].sum()), ids, [{"w": w, "k": tail_class(w), "n": c} for w, c in mine.items()]))
                    rid += 1
                part = batch.slice(first, len(texts))
                tail = pa.list_(pa.struct([("w", pa.binary()), ("k", pa.int32()), ("n", pa.int32())]))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), tail), strict=True)]
                yield pa.RecordBatch.from_arrays([cols[0], part.column("doc_id"), part.column("held_out"), *cols[1:]], names=["rid", "doc_id", "held_out", "n_tokens", "head_known", "base", "symbols", "tail"])

    coded = saved(keyed.mapInArrow(encode, ENCODED.format(kind_of_id)), "coded")
    train = coded.filter("not held_out").select("symbols")
    sample = saved(chosen(coded.filter("not held_out").select("doc_id", "symbols"), sample_docs, "doc_id", "symbols", total=ends).select("symbols"), "sample").repartition(8)
    model = first_guess([np.array(r["symbols"], np.int32) for r in sample.limit(400).collect()], share, states)
    for corpus, times in ((sample, sample_turns), (train, turns)):
        for _ in range(times):
            model, _ = reestimated(corpus, model, share)
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            docs = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("symbols")]
            out = np.zeros(len(docs))
            for some, symbols, first in lanes(docs):
                out[some] = forward(m, symbols, first, False)[0]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "head_known", "base")] + [pa.array(out)], names=["rid", "doc_id", "held_out", "n_tokens", "head_known", "base", "chain"])

    judged = coded.drop("tail").mapInArrow(judge, f"rid long, doc_id {kind_of_id}, held_out boolean, n_tokens long, head_known long, base double, chain double")
    rare = coded.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.w").alias("word"), F.col("t.k").alias("k"), F.col("t.n").alias("m"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    within = F.lit(0.0)
    for k, (c, types) in enumerate(tails):
        within = F.when(F.col("k") == k, F.log10((F.col("c") + 0.5) / (c + 0.5 * (types + 1)))).otherwise(within)
    sums = met.groupBy("rid").agg(F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / scale)).alias("tail_base"), F.sum(F.col("m") * within).alias("tail_score"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("tail_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = judged.join(sums, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("chain") + zero("tail_score")).alias("score"))


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
