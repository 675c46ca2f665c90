"""Shards of equal depth over keys of any type and number of columns.

Cuts come from the sorted keys of a sample, whose size is a parameter, so shards hold about as many rows each whatever the
keys' gaps and skew. With `SAMPLE` rows and n shards a shard strays from the mean by a share of about sqrt(n / SAMPLE), one
part in 25 for 32 shards. A key that more rows share than a shard should hold is not split. Keys with a null in any column
belong to the first shard. Plans are written once and read by later runs, so a copy is resumed by the cuts that it began with.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..sources.files import Folder

SAMPLE = 20_000


def _text(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value}'"
    return str(value)


@dataclass(frozen=True)
class KeyRange:
    """Keys from low on and below high, by columns in order; None is an open end."""

    name: str
    keys: tuple[str, ...]
    low: tuple | None
    high: tuple | None

    def predicate(self, engine: str = "oracle") -> str:
        """As SQL for a database, in terms that need no row values: a > x OR (a = x AND b >= y)."""
        names = [quoted(k, engine) for k in self.keys]

        def bound(cut: tuple, last: str, strict: str) -> str:
            ways = []
            for i, v in enumerate(cut):
                same = [f"{n} = {_text(x)}" for n, x in zip(names[:i], cut[:i], strict=True)]
                ways.append("(" + " AND ".join([*same, f"{names[i]} {last if i == len(cut) - 1 else strict} {_text(v)}"]) + ")")
            return "(" + " OR ".join(ways) + ")"

        parts = ([bound(self.low, ">=", ">")] if self.low else []) + ([bound(self.high, "<", "<")] if self.high else [])
        if self.low is None:
            return " OR ".join([f"({' AND '.join(parts) or '1 = 1'})", *(f"{n} IS NULL" for n in names)])
        return " AND ".join([*parts, *(f"{n} IS NOT NULL" for n in names)])

    def column(self) -> Column:
        key, whole = F.struct(*(F.col(f"`{k}`") for k in self.keys)), F.lit(True)
        for k in self.keys:
            whole = whole & F.col(f"`{k}`").isNotNull()
        cut = lambda c: F.struct(*(F.lit(v).alias(k) for k, v in zip(self.keys, c, strict=True)))
        if len(self.keys) == 1:  # a plain comparison is compiled, that of structs is not
            key, cut = F.col(f"`{self.keys[0]}`"), lambda c: F.lit(c[0])
        inside = F.lit(True) if self.low is None else key >= cut(self.low)
        inside = inside & (key < cut(self.high)) if self.high is not None else inside
        inside = F.coalesce(inside, F.lit(False))
        return (inside | ~whole) if self.low is None else (inside & whole)


def cuts_of(df: DataFrame, keys: Sequence[str], shards: int, sample: int = SAMPLE, rows: int | None = None) -> list[tuple]:
    """Keys that part df into about equal shards, at most shards - 1 of them. The driver gets the cuts, one task the sample."""
    own = df.select(*keys).dropna()
    rows = own.count() if rows is None else rows
    some = own.sample(min(1.0, sample / rows), seed=1) if rows > sample else own
    tiles = some.withColumn("__tile", F.ntile(shards).over(Window.orderBy(*keys)))
    found = tiles.groupBy("__tile").agg(F.min(F.struct(*keys)).alias("cut")).orderBy("__tile").collect()  # a row for each shard
    return sorted({tuple(r["cut"]) for r in found[1:]} - {tuple(r["cut"]) for r in found[:1]})


def ranges(keys: Sequence[str], cuts: Sequence[tuple]) -> list[KeyRange]:
    ends = [None, *cuts, None]
    return [KeyRange(f"{i + 1}of{len(ends) - 1}", tuple(keys), a, b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def index(df: DataFrame, parts: Sequence[KeyRange]) -> Column:
    """The number of each row's shard, from 0."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(parts))):
        out = F.when(p.column(), i).otherwise(out)
    return out


def planned(df: DataFrame, keys: Sequence[str], shards: int, path: str, sample: int = SAMPLE) -> list[KeyRange]:
    """The ranges of a plan at path; the first run makes it."""
    files = Folder(df.sparkSession, path)
    text = files.read("_cuts")
    if text is None:
        files.create("_cuts", json.dumps([[_kept(v) for v in c] for c in cuts_of(df, keys, shards, sample)]))
        text = files.read("_cuts")  # another run may have been first
    return ranges(keys, [tuple(_back(v) for v in c) for c in json.loads(text)])


def _kept(value: object) -> object:
    if isinstance(value, dt.datetime):
        return {"time": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    return {"decimal": str(value)} if isinstance(value, Decimal) else value


def _back(value: object) -> object:
    if isinstance(value, dict):
        (kind, text), = value.items()
        return dt.datetime.fromisoformat(text) if kind == "time" else dt.date.fromisoformat(text) if kind == "date" else Decimal(text)
    return value
