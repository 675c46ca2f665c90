"""Mixing sources to target weights by the cube method of balanced sampling.

A source's share target / size gives each of its documents the same number of expected copies, at most ``max_repeat``.
The whole part is taken outright; the fraction is an inclusion probability. The flight phase moves the probabilities of a
block along the null space of the constraint matrix (one row counts documents, one counts words) until no three of them
are fractional, so a block's document and word totals stay as they were. What is left of the blocks, two documents each,
forms blocks of the next level. A source's last block holds ``HOLD`` documents back from the flight; they and what the flight
leaves, ``HOLD + 2`` at most, are the landing problem: of all their subsets with the right number of documents (the next
whole numbers) that which comes nearest to the words still due. The flight decides the ``LEAD`` largest documents first, while
all others can make up for them, and those held back are of all sizes of the rest. Nothing that the flight has decided is touched again, so a source's documents come out
within one of their expected number, and its words as near as some ten thousand sums allow; only a document that outweighs
all the rest of its source together may leave more.

Blocks are dealt by a hash of row numbers within a source, so a source that holds a third of all rows is many blocks, also
where its rows are all alike, and each level divides the number of fractional rows by ``block / 2``.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; repeated rows are
units of their own; all randomness comes from hashes, so reruns agree; an empty table gives an empty table; sources
without words get the target 0; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shards import numbered
from .common import WORD, read, saved, text_key

WEIGHTS, MAX_REPEAT, BLOCK, HOLD, LEAD = (1.0, 2.0, 3.0), 3.0, 5_000, 14, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """sources (source, source_size, docs) with their target: weights by rank, all sizes shared out, max_repeat times a size at most."""
    cap = F.col("source_size") * F.lit(float(max_repeat))
    weighed = saved(numbered(sources, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))), "sources")
    total, level = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0
    if total:
        while True:  # one step for each set of sources that reach their cap; the level only rises
            over = F.col("weight") * F.lit(level) >= cap
            kept, open_weight = weighed.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
            new = (total - kept) / open_weight if open_weight else level
            if new <= level * (1 + 1e-12):
                break
            level = new
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))).drop("weight", "rank")


def draw(*parts: object) -> float:
    """A number in [0, 1) that depends on the parts only."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=7).digest(), "big") / 2**56


@functools.cache
def subsets(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All subsets of n things as rows of 0 and 1, and their sizes."""
    rows = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    return rows, rows.sum(1)


def landed(p: Sequence[float], x: Sequence[float]) -> list[float]:
    """The subset (0 or 1 each) whose number is a neighbour of sum(p) and whose sum of x is nearest to that of p * x."""
    rows, number = subsets(len(p))
    fits = np.flatnonzero(np.abs(number - sum(p)) < 1 - 1e-6)
    return rows[fits[np.abs(rows[fits] @ np.array(x) - np.dot(p, x)).argmin()]].tolist()


def decide_largest(p: np.ndarray, x: np.ndarray, rng: Sequence[float], lead: int = LEAD) -> int:
    """Moves p along projections on the null space until the `lead` largest are decided; all others make up for them. Returns the draws taken."""
    largest = np.argsort(-x, kind="stable")
    largest = largest[(p[largest] > 1e-9) & (p[largest] < 1 - 1e-9)]
    r, rows = 0, np.stack([np.ones(len(x)), x / max(1.0, x.max(initial=0))])
    for k in largest[: min(lead, len(largest) // 4)].tolist():
        while 1e-9 < p[k] < 1 - 1e-9:
            w = np.where((p > 1e-9) & (p < 1 - 1e-9), p * (1 - p), 0.0)
            moved = rows * w
            u = -(np.linalg.pinv(moved @ rows.T) @ moved[:, k]) @ moved
            u[k] += w[k]
            if abs(u[k]) < 1e-12:
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
                down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
            p += u * (up if rng[r] * (up + down) < down else -down)
            np.clip(p, 0, 1, out=p)
            r += 1
    return r


def flight(prob: np.ndarray, size: np.ndarray, seed: str, land: bool = False) -> np.ndarray:
    """prob moved until at most two entries are fractional (none with land)."""
    p, x = prob.astype(float), size.astype(float)
    rng = np.random.default_rng(int(draw(seed) * 2**53)).random(2 * len(p) + 8).tolist()
    r, eps, pool = decide_largest(p, x, rng), 1e-9, []
    p, x = p.tolist(), x.tolist()
    open_ = sorted((i for i, v in enumerate(p) if 1e-9 < v < 1 - 1e-9), key=lambda i: -x[i])
    held = set(np.linspace(0, len(open_) - 1, HOLD).astype(int).tolist() if len(open_) > HOLD + 2 else range(len(open_))) if land else set()
    last = [open_[j] for j in sorted(held)]
    for i in (v for j, v in enumerate(open_) if j not in held):
        pool.append(i)
        while len(pool) >= 3:
            a, b, c = pool[-3:]
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, v in zip((a, b, c), u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
            step = up if rng[r] * (up + down) < down else -down
            r += 1
            for k, v in zip((a, b, c), u, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + step * v))
            pool[-3:] = [k for k in (a, b, c) if eps < p[k] < 1 - eps]
    if land and (pool := pool + last):
        for k, v in zip(pool, landed([p[k] for k in pool], [x[k] for k in pool]), strict=True):
            p[k] = v
    return np.where(np.abs(np.array(p) - np.round(p)) <= eps, np.round(p), p) if p else np.zeros(0)


def sampled(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units (any columns, and row, source, size, docs, prob) with prob 0 or 1."""
    schema = T.StructType([*units.schema.fields, T.StructField("level", T.IntegerType())])
    names = [f.name for f in schema]
    largest = units.agg(F.max("docs")).first()[0] or 0
    done, level, at = None, 0, units
    while True:
        last = largest <= block
        blocks = F.lit(1) if last else F.ceil(F.col("docs") / F.lit(block * (block // 2) ** level))
        row = F.xxhash64("row", F.lit("block"))

        def fly(rows):  # runs before the next turn of the loop
            size, order = rows["size"].to_numpy(), rows["__o"].to_numpy()
            turn = np.lexsort((size, order))
            prob = np.empty(len(size))
            prob[turn] = flight(rows["prob"].to_numpy()[turn], size[turn], f"{level}|{rows['source'][0].as_py()}|{order[turn[0]]}", last)
            rows = rows.set_column(rows.column_names.index("prob"), "prob", pa.array(prob))
            return rows.append_column("level", pa.array(np.full(len(size), level, np.int32))).select(names)

        keyed = at.withColumns({"__b": F.pmod(row, F.greatest(blocks, F.lit(1))).cast("long"), "__o": F.xxhash64("row", F.lit("order"))})
        flown = saved(keyed.groupBy("source", "__b").applyInArrow(fly, schema), "flight")
        whole = flown if last else flown.filter("prob = 0 or prob = 1")
        done = whole if done is None else done.unionByName(whole)
        if last:
            return done.drop("level")
        at, largest, level = flown.filter("prob > 0 and prob < 1").drop("level"), -(-largest * 2 // block), level + 1


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies and taken = copies * size."""
    return mix_sizes(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), weights, max_repeat, block)


def mix_sizes(units: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """The mix of units (doc_id, source, size)."""
    # rows are numbered in the order of a hash; those that are alike are next to each other, and any of them may come first
    alike = F.xxhash64("doc_id", "source", "size")
    sizes = numbered(saved(units, "sizes").withColumn("__r", F.monotonically_increasing_id()), [alike, F.col("__r")], "row").drop("__r")
    sources = with_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, max_repeat)
    # a row per source against all documents: small against them, and AQE broadcasts it only below its size limit
    salt = F.pmod(F.col("row"), F.lit(16)).cast("int")
    wide = sources.withColumns({"__n": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))), "__s": F.explode(F.sequence(F.lit(0), F.lit(15)))}).drop("source")
    units = sizes.withColumns({"__n": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))), "__s": salt}).join(wide, ["__n", "__s"]).drop("__n", "__s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(1.0))
    base = F.floor(rate + 1e-12)
    units = units.withColumns({"base": base.cast("long"), "prob": F.greatest(rate - base, F.lit(0.0))})
    out = sampled(units, block).withColumn("copies", F.col("base") + F.col("prob").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """The rows of docs that the mix takes, with `copies` (how often each counts) and `size`. Rows equal in id, source and text share one decision."""
    key = [F.col(doc_id).alias("u"), F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("w"), *text_key(F.col(text))]
    names = ["u", "w", "k1", "k2"]
    units = docs.groupBy(*key).agg(F.first(word_count(F.col(text))).alias("size"))
    taken = saved(mix_sizes(units.select(F.struct(*names).alias("doc_id"), F.col("w").alias("source"), "size"), **kw).filter("copies > 0").select("doc_id.*", "copies", "size"), "taken")
    keyed = docs.withColumns({f"__{c}": k for c, k in zip(names, key, strict=True)})
    taken = taken.withColumnsRenamed({c: f"__t{c}" for c in names} | {"copies": "__copies", "size": "__size"})
    match = [F.col(f"__{c}").eqNullSafe(F.col(f"__t{c}")) for c in names]
    out = keyed.join(taken, match)
    rest = [c for c in docs.columns if c not in ("copies", "size")]
    return out.select(*(F.col(f"`{c}`") for c in rest), F.col("__copies").alias("copies"), F.col("__size").alias("size"))


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
