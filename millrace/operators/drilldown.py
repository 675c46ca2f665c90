"""Where two versions of a table differ, by a tree of checksums over key ranges.

The first level reads both tables once and compares checksums by range. Only ranges that differ are cut again, and read
again, until they are small; the rows of those left are compared. So tables that agree cost one scan, and a few differences
a scan and a few ranges. Cuts are of equal depth in the source, for keys of any type and number; the ends are open, so that
target rows outside the source's keys belong to some range. Predicates on the first key column reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyranges
from .keyranges import KeyRange
from .reconcile import checksum, diff

FANOUT, LEAF_ROWS, DEEPEST = 64, 10_000, 6


@dataclass(frozen=True)
class Level:
    ranges: int
    rows: int  # of both tables, read for this level
    differing: int


def within(df: DataFrame, parts: Sequence[KeyRange]) -> DataFrame:
    """The rows of some ranges. Besides the exact filter there is one on the first key column that a scan can use."""
    if any(p.low is None and p.high is None for p in parts):
        return df
    k = F.col(f"`{parts[0].keys[0]}`")

    def coarse(p: KeyRange) -> Column:
        ends = ([k >= F.lit(p.low[0])] if p.low else []) + ([k <= F.lit(p.high[0])] if p.high else [])
        out = reduce(Column.__and__, ends)
        return out if p.low else reduce(Column.__or__, [out, *(F.col(f"`{c}`").isNull() for c in p.keys)])

    return df.filter(reduce(Column.__or__, map(coarse, parts))).filter(reduce(Column.__or__, [p.column() for p in parts]))


def _differing(source: DataFrame, target: DataFrame, parts: Sequence[KeyRange], columns: Sequence[str]) -> tuple[list[tuple[KeyRange, int]], int]:
    """(the ranges that differ with their rows in both tables, rows read)."""
    sides = [{r["__range"]: r.asDict() for r in checksum(df.withColumn("__range", keyranges.index(df, parts)), columns, ["__range"]).collect()} for df in (source, target)]  # a row for each range
    rows, out = 0, []
    for i, p in enumerate(parts):
        s, t = (x.get(i) for x in sides)
        n = sum(x["row_count"] for x in (s, t) if x)
        rows += n
        if s != t:
            out.append((p, n))
    return out, rows


def drill_down(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, list[Level]]:
    """(the keys of rows to insert, update or delete in target, with the action; what each level read).

    A range that no key cuts further, such as that of one key which many rows share, is a leaf whatever its rows.
    """
    names = list(columns or source.columns)
    open_, leaves, levels = [KeyRange("all", tuple(keys), None, None)], [], []
    while open_ and len(levels) < DEEPEST:
        parts = []
        for p in open_:
            ends = [p.low, *(c for c in keyranges.cuts_of(within(source, [p]), keys, fanout) if c != p.low), p.high]
            parts += [KeyRange(f"{p.name}.{i}", p.keys, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        found, rows = _differing(within(source, open_), within(target, open_), parts, names)
        levels.append(Level(len(parts), rows, len(found)))
        whole = {(p.low, p.high) for p in open_}
        leaves += [p for p, n in found if n <= leaf_rows or (p.low, p.high) in whole]
        open_ = [p for p, n in found if n > leaf_rows and (p.low, p.high) not in whole]
    leaves += open_
    if not leaves:
        return diff(source.limit(0), target.limit(0), keys, names), levels
    return diff(within(source, leaves), within(target, leaves), keys, names), levels
