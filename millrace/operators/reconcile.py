"""Checksums, comparison and synchronisation of two versions of a table.

Every operator is one plan: hash joins on canonical keys and map-side aggregation. Tables are compared whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import LARGE, canonical, row_hash


def hashed_columns(df: DataFrame, large: Sequence[str] = ()) -> list[str]:
    """The columns that a checksum covers by default: all but binary ones and those named as large text of another engine."""
    return [f.name for f in df.schema if not isinstance(f.dataType, LARGE) and f.name not in large]


def totals(hash_: str = "__h") -> list[Column]:
    """Rows, XOR and sum of row hashes. XOR alone would miss a pair of equal rows, hence the sum beside it."""
    return [F.count("*").alias("row_count"), F.coalesce(F.bit_xor(hash_), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(F.col(hash_) % (1 << 31)), F.lit(0)).alias("hash_sum")]


def checksum(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[Column | str] = ()) -> DataFrame:
    """Rows, XOR and sum of the row hashes, of df or by group. Shards' figures combine by sum, XOR and sum."""
    return df.withColumn("__h", row_hash(df, columns or hashed_columns(df))).groupBy(*by).agg(*totals())


def combine_checksums(shards: DataFrame, by: Sequence[str] = (), ok: str | None = None) -> DataFrame:
    """One row for the shards of each table; a shard without a checksum makes the whole unknown, one that failed fails it."""
    whole = F.count("*") == F.count("hash_xor")
    out = [F.sum("row_count").alias("row_count"), F.when(whole, F.bit_xor("hash_xor")).alias("hash_xor"), F.when(whole, F.sum("hash_sum")).alias("hash_sum")]
    return shards.groupBy(*by).agg(*out, *([F.bool_and(ok).alias(ok)] if ok else []))


def validate(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: both counts and checksums, and whether they agree."""
    names = list(columns or source.columns)
    s, t = checksum(source.select(*names)), checksum(target.select(*names))
    return s.select(*(F.col(c).alias(f"source_{c}") for c in s.columns)).join(t.select(*(F.col(c).alias(f"target_{c}") for c in t.columns))).withColumns(
        {"same_count": F.col("source_row_count") == F.col("target_row_count"), "same_content": (F.col("source_row_count") == F.col("target_row_count")) & (F.col("source_hash_xor") == F.col("target_hash_xor")) & (F.col("source_hash_sum") == F.col("target_hash_sum"))}
    )  # one row on each side


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.withColumns({f"__k{i}": F.col(f"`{k}`").cast("long") if isinstance(kinds[k], integral) else canonical(F.col(f"`{k}`"), kinds[k]) for i, k in enumerate(keys)})


def _met(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i in range(len(keys)):
        out = out & F.col(f"{a}.__k{i}").eqNullSafe(F.col(f"{b}.__k{i}"))
    return out


def diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, deletes: bool = True) -> DataFrame:
    """The keys of rows to insert, update or (with deletes) delete in target, with the action. Null keys meet null keys."""
    names = list(columns or source.columns)
    s = _keyed(source.withColumn("__h", row_hash(source, names)), keys).withColumn("__here", F.lit(1)).alias("s")
    t = _keyed(target.withColumn("__h", row_hash(target, names)), keys).withColumn("__here", F.lit(1)).alias("t")
    both = s.join(t, _met("s", "t", keys), "full" if deletes else "left")
    action = F.when(F.col("t.__here").isNull(), "insert").when(F.col("s.__here").isNull(), "delete").when(F.col("s.__h") != F.col("t.__h"), "update")
    return both.select(*(F.coalesce(F.col(f"s.`{k}`"), F.col(f"t.`{k}`")).alias(k) for k in keys), action.alias("action")).filter("action is not null")


def apply_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], deletes: bool = True) -> DataFrame:
    """target after its synchronisation with source: the next snapshot. With deletes that is the source; without, also the rows of keys that it lacks."""
    fresh = source.select(*(F.col(f"`{c}`") for c in target.columns))
    return fresh if deletes else fresh.unionByName(keys_missing(target, source, keys))


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of changes put in by key, in place of all rows of that key; with key columns only, existing rows stay as they are."""
    return apply_diff(changes, target, keys, deletes=False)


def keys_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of target whose key source lacks."""
    return _keyed(target, keys).alias("t").join(_keyed(source, keys).alias("s"), _met("t", "s", keys), "left_anti").select(*(F.col(f"t.`{c}`") for c in target.columns))


def select_by_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _keyed(df, keys).alias("d").join(_keyed(wanted, keys).alias("w"), _met("d", "w", keys), "left_semi").select(*(F.col(f"d.`{c}`") for c in df.columns))


def delete_by_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keys_missing(df, gone, keys)


def since(df: DataFrame, change: str, mark: str | None) -> DataFrame:
    """Rows changed at the mark or later; the bound is inclusive, since rows may share the mark's time."""
    return df if mark is None else df.filter(F.col(change) >= F.lit(mark).cast(df.schema[change].dataType))


def next_mark(df: DataFrame, change: str, mark: str | None = None) -> DataFrame:
    """The high-water mark as ISO text, without a fraction of zero; the old mark if there are no rows."""
    top = F.max(F.col(change).cast("timestamp_ntz"))
    text = F.regexp_replace(F.date_format(top, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
    return df.agg(F.coalesce(text, F.lit(mark)).alias("mark"))


def latest(changes: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last change of each key. An aggregate, so a key of many changes is combined before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return changes.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"__r.`{c}`").alias(c) for c in changes.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
