"""Key-range shards: bounds, predicates, assignment, batches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept

MIN_ROWS, MAX_SHARDS = 1_000_000, 8


@dataclass(frozen=True)
class Shard:
    name: str
    low: int | None
    high: int | None

    def predicate(self, key: str) -> str:
        parts = ([f"{key} >= {self.low}"] if self.low is not None else []) + ([f"{key} < {self.high}"] if self.high is not None else [])
        return " AND ".join(parts) or "1 = 1"


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"))


def cut_points(low: int, high: int, shards: int) -> list[int]:
    """Where to cut [low, high]: never more shards than keys."""
    n = min(shards, high - low + 1)
    if n <= 1 or high <= low:
        return []
    step = (high - low + 1) // n
    return sorted({low + step * i for i in range(1, n)})


def shards_of(low: int, high: int, shards: int) -> list[Shard]:
    """Disjoint shards that cover every key, with open ends for rows that arrive later."""
    cuts = cut_points(low, high, shards)
    ends = [None, *cuts, None]
    return [Shard(f"{i + 1}of{len(ends) - 1}", a, b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def plan(df: DataFrame, keys: Sequence[str], max_shards: int = MAX_SHARDS, min_rows: int = MIN_ROWS) -> tuple[list[Shard], str]:
    """(shards, reason); one shard with the reason where sharding isn't possible or doesn't pay."""
    whole = [Shard("1of1", None, None)]
    if len(keys) != 1:
        return whole, "the key is not a single column"
    kind = df.schema[keys[0]].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return whole, f"{keys[0]} is no integer"
    low, high, rows = df.agg(F.min(keys[0]), F.max(keys[0]), F.count("*")).first()
    if rows < min_rows:
        return whole, f"{rows} rows are fewer than {min_rows}"
    found = shards_of(int(low), int(high), max_shards)
    return found, f"{len(found)} shards of {keys[0]}"


def shard_index(key: Column, cuts: Sequence[int]) -> Column:
    """The shard of a key, from 0; null keys go with the first."""
    out = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        out = F.when(key < cuts[i], i).otherwise(out)
    return F.when(key.isNull(), 0).otherwise(out)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """df with row numbers from 1 by `order`, without one task for all rows: numbers within ranges plus the ranges' offsets."""
    own = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    offsets, before = [], 0
    for r in own.groupBy("__p").count().orderBy("__p").collect():  # a row for each range
        offsets.append((r["__p"], before))
        before += r["count"]
    off = df.sparkSession.createDataFrame(offsets, "__p int, __before long")
    return own.join(F.broadcast(off), "__p").withColumn(name, F.col("__before") + F.col("__i") + 1).drop("__p", "__i", "__before")


def batches(df: DataFrame, order: Sequence[str], size: int = 5000) -> DataFrame:
    """Rows, first and last key of each batch in key order, as a copy in batches would see them."""
    return numbered(df, order).withColumn("batch", F.expr(f"(row_no - 1) div {size}")).groupBy("batch").agg(F.count("*").alias("row_count"), F.min(order[0]).alias("first_key"), F.max(order[0]).alias("last_key"))


@dataclass(frozen=True)
class Bound:
    """RANGE: [the previous bound, upper), None for no upper limit. LIST: values, or none for the default."""

    name: str
    upper: object = None
    values: tuple = ()
    default: bool = False


#: A bound that means the same everywhere: a number, a quoted text, a date given by its mask. Fixed values.
NUMBER_BOUND, TEXT_BOUND, DATE_BOUND = re.compile(r"-?\d+(\.\d+)?"), re.compile(r"'([^']*)'"), re.compile(r"(?i)to_date\(\s*'\s*([^']*?)\s*'.*\)")


def partition_plan(kind: str, columns: Sequence[str], bounds: Mapping[str, str], parts_of_parts: bool = False) -> tuple[list[Bound] | None, str]:
    """(buckets, ""), or (None, the reason) where a table should stay in one piece. bounds: partition to its bound's text, in order."""
    if parts_of_parts:
        return None, "partitions of partitions are not carried over"
    if kind.upper() not in ("RANGE", "LIST"):
        return None, f"{kind.upper()} partitions have no bounds to carry over"
    if len(columns) != 1:
        return None, f"a key of {len(columns)} columns"
    out = []
    for name, text in bounds.items():
        raw = text.strip()
        if raw.upper() in ("MAXVALUE", "DEFAULT"):
            out.append(Bound(name, default=raw.upper() == "DEFAULT"))
            continue
        values = [_bound(x) for x in re.findall(r"(?i)to_date\([^)]*\)|'[^']*'|[^,]+", raw)]
        if None in values or kind.upper() == "RANGE" and len(values) != 1:
            return None, f"the bound of {name} is not understood: {raw}"
        out.append(Bound(name, values[0]) if kind.upper() == "RANGE" else Bound(name, values=tuple(values)))
    if kind.upper() == "RANGE":
        tops = [b.upper for b in out]
        if None in tops[:-1] or any(type(a) is not type(b) or a >= b for a, b in zip(tops, tops[1:], strict=False) if b is not None):
            return None, "the bounds do not rise"
    return out, ""


def _bound(text: str) -> object:
    raw = text.strip()
    if NUMBER_BOUND.fullmatch(raw):
        return float(raw) if "." in raw else int(raw)
    found = TEXT_BOUND.fullmatch(raw) or DATE_BOUND.fullmatch(raw)
    return found[1] if found else None


def range_bucket(col: Column, bounds: Sequence[Bound]) -> Column:
    out = F.lit(None).cast("string")
    for b in reversed(bounds):
        out = F.when(F.lit(True) if b.upper is None else col < F.lit(b.upper), b.name).otherwise(out)
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(out)


def list_bucket(col: Column, bounds: Sequence[Bound]) -> Column:
    out = F.lit(next((b.name for b in bounds if b.default), None)).cast("string")
    for b in reversed([b for b in bounds if not b.default]):
        out = F.when(col.isin(*b.values), b.name).otherwise(out)
    return out
