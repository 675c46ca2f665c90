"""Comparison and ordering of schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_diff(source: DataFrame, target: DataFrame, column: str = "name") -> DataFrame:
    """Names in one side only or in both, whatever their case; the source's spelling first, else the target's."""
    s = source.groupBy(F.upper(column).alias("u")).agg(F.min(column).alias("s"))
    t = target.groupBy(F.upper(column).alias("u")).agg(F.min(column).alias("t"))
    where = F.when(F.col("t").isNull(), "source_only").when(F.col("s").isNull(), "target_only").otherwise("both")
    return s.join(t, "u", "full").select(F.coalesce("s", "t").alias("name"), where.alias("where"))


def shape(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "name string, type string, nullable boolean")


def missing_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """The columns of source that target lacks, whatever their case; no rows are read."""
    there = {c.upper() for c in target.columns}
    return [c for c in source.columns if c.upper() not in there]


def waves(tables: Iterable[str], references: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """Tables in waves, parents first; edges to tables outside and to itself don't count; a cycle is one last wave."""
    names = list(tables)
    inside = {n.upper() for n in names}
    open_ = {n: {p.upper() for p in references.get(n, ())} & inside - {n.upper()} for n in names}
    out = []
    while open_:
        ready = [n for n in names if n in open_ and not open_[n]] or list(open_)
        out.append(ready)
        for n in ready:
            del open_[n]
        done = {n.upper() for n in ready}
        open_ = {n: p - done for n, p in open_.items()}
    return out


def subset(tables: Iterable[str], references: Mapping[str, Iterable[str]], wanted: Iterable[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(the wanted tables, references dropped because they lead outside)."""
    keep = {w.upper() for w in wanted}
    chosen = [t for t in tables if t.upper() in keep]
    return chosen, [(t, p) for t in chosen for p in references.get(t, ()) if p.upper() not in keep]


@dataclass(frozen=True)
class Dropped:
    kind: str  # reference, trigger or view
    name: str
    reason: str


def subset_objects(tables: Iterable[str], references: Mapping[str, Iterable[str]], wanted: Iterable[str], triggers: Mapping[str, str] | None = None, views: Mapping[str, Iterable[str]] | None = None) -> tuple[list[str], list[str], list[str], list[Dropped]]:
    """(tables, triggers, views, what was dropped and why). triggers: name to table; views: name to the tables and views it reads."""
    names = list(tables)
    chosen, lost = subset(names, references, wanted)
    have, gone = {t.upper() for t in chosen}, {t.upper() for t in names} - {t.upper() for t in chosen}
    dropped = [Dropped("reference", f"{t} to {p}", f"{p} is left out") for t, p in lost]
    kept_triggers = []
    for name, table in (triggers or {}).items():
        if table.upper() in have:
            kept_triggers.append(name)
        else:
            dropped.append(Dropped("trigger", name, f"{table} is left out"))
    left = dict(views or {})
    while True:  # a view of a dropped view goes too
        bad = {v: next(x for x in reads if x.upper() in gone) for v, reads in left.items() if any(x.upper() in gone for x in reads)}
        if not bad:
            return chosen, kept_triggers, list(left), dropped
        dropped += [Dropped("view", v, f"it reads {x}, which is left out") for v, x in bad.items()]
        gone |= {v.upper() for v in bad}
        left = {v: r for v, r in left.items() if v not in bad}
