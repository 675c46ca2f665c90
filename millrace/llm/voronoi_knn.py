"""Exact top-k search by inner product: a Voronoi kNN join.

Components become integers, floor(scale * x). Pivots are real vectors, a bounded sample chosen by the ids' hashes; their
number grows with the square root of the table, up to ``PIVOTS``. Queries and data are both grouped by the nearest pivot of
their length. Against a pivot's direction a vector has a part along it and a part across; so for a query q and a vector x
of a group, q.x <= q_along * x_along + |q_across| * |x_across|, from summaries of a group or from a member's own two figures.

A query's k-th best score over the sample is a limit that its results must reach. A query group's summary holds its radius
about its pivot, its longest query and its lowest limit; a data group's its extent along and across. From these the driver
derives which groups can meet at all (a table of pivots by pivots). A query then goes to those of its group's partners that
its own bound allows, and is solved locally: members whose bound stays under its limit are not scored. Data are replicated
only where a group has more than ``QUERY_PART`` queries to meet; a group of many members is several blocks, so a vector
that a third of the rows repeat is no hot key.

On vectors without clusters in many dimensions no such bound can exclude much, and nearly all pairs are scored.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as queries neither;
vectors of other lengths than the query's are no candidates; lengths so rare that no pivot has them are compared within
themselves; ties go to the smaller id; the query's own row (same id) is no candidate; fewer than k candidates give fewer
rows; an empty table gives an empty table. Repeated ids of candidates are rows of their own; a repeated query id is asked
once, with the smallest vector. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chosen, read, saved

SCALE, K, PIVOTS, BLOCK, QUERIES, QUERY_PART, RARE_BLOCKS = 1024, 10, 2048, 8192, 128, 16_384, 8


def whole_vectors(df: DataFrame, vec_id: str, vec: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform(F.col(vec), lambda e: e.cast("double"))
    fine = F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == math.inf))
    return df.filter(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where every partial sum fits their 53 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if top < 2**63 else np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= limit)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors of each length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, at, rows_of(column if len(at) == len(sizes) else column.take(pa.array(at)), n)


class Pivots:
    """The sample of one length: pivots, their directions, and all vectors of the sample with their ids."""

    def __init__(self, first: int, vectors: np.ndarray, ids: np.ndarray, sample: np.ndarray):
        self.first, self.p, self.ids, self.sample = first, vectors.astype(float), ids, sample
        self.norms = (self.p**2).sum(1)
        self.unit = self.p / np.maximum(np.sqrt(self.norms), 1e-300)[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (self.norms - 2 * x @ self.p.T).argmin(1)

    def parts(self, x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the part along its group's pivot and the length of that across."""
        along = (x * self.unit[g]).sum(1)
        return along, np.sqrt(np.maximum((x**2).sum(1) - along**2, 0))


def sampled(data: DataFrame, pivots: int) -> dict[int, Pivots]:
    """By length. Pivots are numbered through all lengths."""
    n = data.count()
    pivots = max(1, min(pivots, math.isqrt(n)))
    by: dict[int, list] = {}
    for r in chosen(data, 4 * pivots, "vec_id", "v", total=n).collect():
        by.setdefault(len(r["v"]), []).append(r)
    out, first = {}, 0
    for length, rows in sorted(by.items()):
        share = -(-pivots * len(rows) // sum(map(len, by.values())))
        centre = np.array(list(dict.fromkeys(tuple(r["v"]) for r in rows))[:share], np.int64)
        out[length] = Pivots(first, centre, np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64))
        first += len(centre)
    return out


def partners(found: dict[int, Pivots], asked: dict[int, tuple], held: dict[int, tuple]) -> dict[int, np.ndarray]:
    """The data groups that a query group may need. asked: g -> (n, radius, longest, limit); held: g -> (n, low, high, across)."""
    out = {}
    for at in found.values():
        mine = np.array([g for g in range(at.first, at.first + len(at.p)) if g in held], int)
        for g in range(at.first, at.first + len(at.p)):
            if g in asked and len(mine):
                _, radius, longest, limit = asked[g]
                _, low, high, across = np.array([held[x] for x in mine], float).T
                mid = at.unit[mine - at.first] @ at.p[g - at.first]  # a query's part along differs from it by the radius at most
                least, most = mid - radius, mid + radius
                along = np.max([a * x for a in (least, most) for x in (low, high)], axis=0)
                beside = np.minimum(longest, np.sqrt(np.maximum(at.norms[g - at.first] - mid**2, 0)) + radius)
                bound = along + beside * across
                out[g] = mine[bound >= limit - 1e-9 * (np.abs(bound) + 1) - 1e-6]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, query_part: int = QUERY_PART, scored: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors and queries: (vec_id long, v array<long>). scored counts the pairs scored."""
    spark = vectors.sparkSession
    data = saved(vectors, "vectors")
    found = sampled(data, pivots)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = spark.sparkContext.broadcast(found)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each vector: group, parts along and across, distance to the pivot, and the limit as a query. A rare length is a group below 0."""
        for b in batches:
            n = b.num_rows
            g, along, across, away, limit = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -np.inf)
            ids = b.column("vec_id").to_numpy()
            for length, at, whole in by_length(b.column("v")):
                here = sent.value.get(length)
                if here is None:
                    g[at] = -length
                    continue
                x = whole.astype(float)
                near = here.nearest(x)
                g[at] = near + here.first
                along[at], across[at] = here.parts(x, near)
                away[at] = np.sqrt(((x - here.p[near]) ** 2).sum(1))
                if limits and len(here.sample) > k:
                    for i in range(0, len(at), QUERIES):
                        s = scores(whole[i : i + QUERIES], here.sample).astype(float)
                        s[ids[at[i : i + QUERIES], None] == here.ids[None, :]] = -np.inf
                        limit[at[i : i + QUERIES]] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *map(pa.array, (g, along, across, away, limit))], names=["vec_id", "v", "g", "along", "across", "away", "limit"])

    schema = "vec_id long, v array<long>, g int, along double, across double, away double, limit double"
    limits = False
    member = saved(data.mapInArrow(grouped, schema), "grouped")
    limits = True
    asked = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(grouped, schema), "asked")
    longest = F.max(F.sqrt(F.col("along") ** 2 + F.col("across") ** 2))
    # a row per pivot
    ask = {r["g"]: tuple(r)[1:] for r in asked.filter("g >= 0").groupBy("g").agg(F.count("*"), F.max("away"), longest, F.min("limit")).collect()}
    hold = {r["g"]: tuple(r)[1:] for r in member.filter("g >= 0").groupBy("g").agg(F.count("*"), F.min("along"), F.max("along"), F.max("across")).collect()}
    meet = partners(found, ask, hold)
    total = sum(len(x.p) for x in found.values())
    blocks, parts, box = np.ones(total, int), np.ones(total, int), np.zeros((total, 3))
    for g, (n, low, high, across) in hold.items():
        blocks[g], box[g] = max(1, -(-n // block)), (low, high, across)
        parts[g] = max(1, -(-sum(ask[q][0] for q, x in meet.items() if g in x) // query_part))
    ways = spark.sparkContext.broadcast((meet, box))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to data groups, by their own bounds among their group's partners."""
        go, extent = ways.value
        for b in batches:
            group, limit = b.column("g").to_numpy(), b.column("limit").to_numpy()
            row, to, along, across = [], [], [], []
            for length, at, whole in by_length(b.column("v")):
                here = sent.value.get(length)
                if here is None:
                    row.append(at)
                    to.append(np.full(len(at), -length))
                    along.append(np.zeros(len(at)))
                    across.append(np.zeros(len(at)))
                    continue
                x = whole.astype(float)
                long = (x**2).sum(1)
                for g in np.unique(group[at]).tolist():
                    near, mine = go.get(g, np.zeros(0, int)), np.flatnonzero(group[at] == g)
                    u = x[mine] @ here.unit[near - here.first].T
                    w = np.sqrt(np.maximum(long[mine, None] - u**2, 0))
                    bound = np.maximum(u * extent[near, 0], u * extent[near, 1]) + w * extent[near, 2]
                    i, j = np.nonzero(bound >= limit[at[mine], None] - 1e-9 * (np.abs(bound) + 1) - 1e-6)
                    row.append(at[mine[i]])
                    to.append(near[j])
                    along.append(u[i, j])
                    across.append(w[i, j])
            row, to, along, across = (np.concatenate(x) if x else np.zeros(0, int) for x in (row, to, along, across))
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pick), b.column("v").take(pick), pa.array(to.astype(np.int32)), pa.array(along.astype(float)), pa.array(across.astype(float)), b.column("limit").take(pick)], names=["id", "v", "g", "along", "across", "limit"])

    def of(numbers: np.ndarray, rare: int) -> Column:
        return F.when(F.col("g") < 0, rare).otherwise(F.element_at(F.lit(numbers.tolist()), F.greatest(F.col("g"), F.lit(0)) + 1))

    columns = ["id", "v", "g", "along", "across", "limit"]
    row = F.monotonically_increasing_id()
    q = asked.mapInArrow(routed, "id long, v array<long>, g int, along double, across double, limit double")
    q = q.select(*columns, F.explode(F.sequence(F.lit(0), of(blocks, RARE_BLOCKS) - 1)).alias("s"), F.pmod(F.xxhash64("id"), of(parts, 1)).cast("int").alias("t"), F.lit(True).alias("query"))
    x = member.join(F.broadcast(spark.createDataFrame([(int(g),) for g in set(np.concatenate([*meet.values(), np.zeros(0, int)]).tolist())] or [(-(1 << 30),)], "g int")), "g", "left_semi").unionByName(member.filter("g < 0"))
    x = x.withColumnRenamed("vec_id", "id").withColumn("s", F.pmod(row, of(blocks, RARE_BLOCKS)).cast("int"))
    x = x.select(*columns, "s", F.explode(F.sequence(F.lit(0), of(parts, 1) - 1)).alias("t"), F.lit(False).alias("query"))

    def solve(rows: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        rows = rows.combine_chunks()
        asking, members = rows.filter(rows["query"]), rows.filter(pc.invert(rows["query"]))
        if not asking.num_rows or not members.num_rows:
            return none
        length = len(asking["v"][0])
        ids, v = members["id"].to_numpy(), rows_of(members["v"].combine_chunks(), length)
        qid, w = asking["id"].to_numpy(), rows_of(asking["v"].combine_chunks(), length)
        u, across = (members[c].to_numpy() for c in ("along", "across"))
        qu, qw, limit = (asking[c].to_numpy() for c in ("along", "across", "limit"))
        rare, out = rows["g"][0].as_py() < 0, []
        order = np.argsort(limit - qu * u.mean(), kind="stable")  # alike queries share a product
        for i in range(0, len(order), QUERIES):
            part = order[i : i + QUERIES]
            bound = qu[part, None] * u + qw[part, None] * across
            may = np.full(bound.shape, True) if rare else bound >= limit[part, None] - 1e-9 * (np.abs(bound) + 1) - 1e-6
            use = np.flatnonzero(may.any(0))
            if not len(use):
                continue
            if scored is not None:
                scored.add(len(part) * len(use))
            s, near_ids = scores(w[part], v[use]), ids[use]
            for j, one in enumerate(s):
                other = np.flatnonzero((near_ids != qid[part[j]]) & (one >= limit[part[j]]))
                near = other[best(near_ids[other], one[other], k)]
                out.append((np.full(len(near), qid[part[j]]), near_ids[near], one[near]))
        return pa.table({n: np.concatenate(c) for n, c in zip(none.column_names, zip(*out, strict=True), strict=True)}) if out else none

    local = q.unionByName(x).groupBy("g", "s", "t").applyInArrow(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
