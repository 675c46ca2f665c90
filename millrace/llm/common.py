"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder as shared_dir
from ..session import kept as saved

__all__ = ["WORD", "WORD_BREAK", "chosen", "chunks", "components", "read", "saved", "shared_dir", "small", "text_key"]

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for the given columns together."""
    return [F.xxhash64(F.lit(1), *cols).alias("k1"), F.xxhash64(F.lit(2), *cols).alias("k2")]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20, rows: int = 2000) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8 bytes) of a batch, in pieces of about `size` bytes."""
    start, held, out = 0, 0, []
    for i, x in enumerate(batch.column(column).cast(pa.binary())):
        out.append(x.as_py())
        held += len(out[-1] or b"")
        if held >= size or len(out) >= rows:
            yield start, out
            start, held, out = i + 1, 0, []
    if out:
        yield start, out


def chosen(df: DataFrame, n: int, *cols: str, total: int | None = None) -> DataFrame:
    """n rows of df by the hash of some columns: a filter leaves about 2 n of them, so no task hands on n rows of its own."""
    total = df.count() if total is None else total
    if total > 4 * n:
        df = df.filter(F.pmod(F.xxhash64(*cols, F.lit("chosen")), F.lit(1 << 30)) < max(1, int((2 * n + 100) / total * (1 << 30))))
    return df.orderBy(F.xxhash64(*cols), *cols).limit(n)


def small(df: DataFrame, name: str, most: int = 10_000) -> DataFrame:
    """df as a table, to be broadcast if it has `most` rows at most; larger ones are joined as the optimizer sees fit."""
    kept = saved(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges (a, b); the label is the smallest node of the component."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:  # labels spread to neighbours, then jump to the label's label: a logarithmic number of turns on long chains
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("node").alias("best"), F.col("label").alias("up"))
        moved = saved(best.join(up, "best").select("node", F.col("label").alias("old"), F.least("best", "up").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
