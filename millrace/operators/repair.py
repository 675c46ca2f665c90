"""Deleting orphans over a whole graph of foreign keys, until none is left.

A deleted row makes orphans of the rows that refer to it. Tables are taken parents first, so in a graph without cycles each
is met once with the keys of its cleaned parents. Tables that refer to each other in a circle, or to themselves, are cleaned
together: rows without a parent go first, then turn by turn only those that refer to keys lost in the last turn, so a turn
costs what was lost and not the tables again. The driver holds the graph, a row for each foreign key, and no keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .integrity import ForeignKey, delete_orphans, orphans

Edge = tuple[str, str, tuple[str, ...], tuple[str, ...]]  # child, parent and their columns


def edges_of(edges: DataFrame) -> list[Edge]:
    """From a table: child, parent (text), child_columns and parent_columns (arrays of text)."""
    return [(r["child"], r["parent"], tuple(r["child_columns"]), tuple(r["parent_columns"])) for r in edges.select("child", "parent", "child_columns", "parent_columns").distinct().orderBy("child", "parent", "child_columns").collect()]  # a row for each key


def components(tables: Sequence[str], edges: Sequence[Edge]) -> list[list[str]]:
    """Tables that refer to each other, together; parents before children."""
    above = {t: {p for c, p, *_ in edges if c == t and p in tables} for t in tables}
    reach = {}
    for t in tables:
        seen, open_ = set(), [t]
        while open_:
            for p in above[open_.pop()] - seen:
                seen.add(p)
                open_.append(p)
        reach[t] = seen
    out, done = [], set()
    for t in sorted(tables, key=lambda t: (len(reach[t]), t)):  # who reaches more comes later, but for members of one circle
        if t not in done:
            out.append(sorted({t} | {p for p in reach[t] if t in reach[p]}))
            done |= set(out[-1])
    return out


def repair_all(tables: Mapping[str, DataFrame], edges: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without orphans, a report: table, row_count, deleted). A key with a null, or to a table not given, is no orphan's."""
    graph = [e for e in edges_of(edges) if e[0] in tables and e[1] in tables]
    clean: dict[str, DataFrame] = {}
    for group in components(list(tables), graph):
        for t in group:
            out = tables[t]
            for c, p, ck, pk in graph:
                if c == t and p not in group:
                    out = delete_orphans(out, clean[p], ForeignKey(f"{c}_{p}", ck, pk))
            clean[t] = kept(out, t) if any(p == t for _, p, *_ in graph) else out
        inner = [e for e in graph if e[0] in group and e[1] in group]
        if inner:
            clean |= _circle({t: clean[t] for t in group}, inner)
    counts = [tables[t].agg(F.lit(t).alias("table"), F.count("*").alias("row_count")).join(clean[t].agg(F.count("*").alias("left"))) for t in tables]  # one row each
    report = reduce(DataFrame.unionByName, counts).select("table", "row_count", (F.col("row_count") - F.col("left")).alias("deleted"))
    return clean, report


def _circle(tables: dict[str, DataFrame], edges: Sequence[Edge]) -> dict[str, DataFrame]:
    own = {t: kept(df.withColumn("__id", F.monotonically_increasing_id()), t) for t, df in tables.items()}
    gone: dict[str, DataFrame] = {}
    fresh: dict[str, list[DataFrame]] = {}
    for c, p, ck, pk in edges:
        fresh.setdefault(c, []).append(orphans(own[c], own[p], ForeignKey("", ck, pk)).select("__id"))
    while True:
        lost = {}
        for t, found in fresh.items():
            new = reduce(DataFrame.unionByName, found).distinct()
            new = kept(new.join(gone[t], "__id", "left_anti") if t in gone else new, "lost")
            if not new.isEmpty():
                lost[t] = new
                gone[t] = kept(gone[t].unionByName(new), "gone") if t in gone else new
        if not lost:
            break
        fresh = {}
        for c, p, ck, pk in edges:
            if p in lost:  # a key is lost when its last row is
                keys = own[p].join(lost[p], "__id", "left_semi").select(*_named(pk)).distinct()
                keys = keys.join(own[p].join(gone[p], "__id", "left_anti").select(*_named(pk)), [f"__k{i}" for i in range(len(pk))], "left_anti")
                fresh.setdefault(c, []).append(own[c].join(keys, [F.col(f"`{a}`") == F.col(f"__k{i}") for i, a in enumerate(ck)], "left_semi").select("__id"))
    return {t: (df.join(gone[t], "__id", "left_anti") if t in gone else df).drop("__id") for t, df in own.items()}


def _named(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)]
