"""Foreign keys, checks and their repair as joins and filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: Sequence[str]
    parent: Sequence[str]


def _whole(fk: ForeignKey) -> Column:
    out = F.lit(True)
    for c in fk.child:
        out = out & F.col(c).isNotNull()
    return out


def _met(fk: ForeignKey) -> Column:
    out = F.lit(True)
    for c, p in zip(fk.child, fk.parent, strict=True):
        out = out & (F.col(f"c.{c}") == F.col(f"p.{p}"))
    return out


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Rows of child whose key is wholly set and that no parent has."""
    return child.filter(_whole(fk)).alias("c").join(parent.select(*fk.parent).alias("p"), _met(fk), "left_anti")


def diagnose(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """One row: orphans, child and parent rows, and whether the parent looks as if it was never loaded.

    Both tables are counted by key in one aggregate, so each is read once, a frequent or null key is combined before the
    shuffle, and nothing is joined. Text meets another type by that type.
    """
    a, b = ([df.schema[c].dataType for c in cs] for df, cs in ((child, fk.child), (parent, fk.parent)))
    common = [(y if isinstance(x, T.StringType) else x).simpleString() if isinstance(x, T.StringType) != isinstance(y, T.StringType) else None for x, y in zip(a, b, strict=True)]

    def keys(df: DataFrame, columns: Sequence[str], mine: int) -> DataFrame:
        return df.select(*((F.col(c).try_cast(k) if k else F.col(c)).alias(f"k{i}") for i, (c, k) in enumerate(zip(columns, common, strict=True))), F.lit(mine).cast("long").alias("c"), F.lit(1 - mine).cast("long").alias("p"))

    names = [f"k{i}" for i in range(len(common))]
    by = keys(child, fk.child, 1).unionByName(keys(parent, fk.parent, 0)).groupBy(*names).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    out = by.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.when(whole & (F.col("p") == 0), F.col("c")).otherwise(0), "orphan_rows"), (F.col("c"), "child_rows"), (F.col("p"), "parent_rows"))))
    return out.select(F.lit(fk.name).alias("fk"), "orphan_rows", "child_rows", "parent_rows", ((F.col("parent_rows") == 0) & (F.col("child_rows") > 0)).alias("parent_looks_empty"))


def null_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """child with every key column of its orphans set to null. Rows with a null in the key take no part in the join."""
    keys = parent.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(fk.parent))).distinct()
    on = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(fk.child)]
    lost = F.col("__p0").isNull()
    met = child.filter(_whole(fk)).join(keys, on, "left").select(*(F.when(lost, None).otherwise(F.col(c)).alias(c) if c in fk.child else F.col(c) for c in child.columns))
    return met.unionByName(child.filter(~_whole(fk)))


def delete_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """child without its orphans; rows with a null in the key stay."""
    found = child.filter(_whole(fk)).alias("c").join(parent.select(*fk.parent).alias("p"), _met(fk), "left_semi")
    return found.unionByName(child.filter(~_whole(fk)))


POLICIES = ("not_valid", "null_orphans", "delete_orphans", "skip", "stop")


def repair(child: DataFrame, parent: DataFrame, fk: ForeignKey, policy: str = "not_valid") -> tuple[DataFrame, DataFrame]:
    """(child after the policy, its diagnosis with the policy and the number of rows changed)."""
    if policy not in POLICIES:
        raise ValueError(f"{policy} is none of {', '.join(POLICIES)}")
    report = diagnose(child, parent, fk)
    changes = policy in ("null_orphans", "delete_orphans")
    report = report.withColumns({"policy": F.lit(policy), "rows_changed": F.col("orphan_rows") if changes else F.lit(0).cast("long")})
    if policy == "stop" and not orphans(child, parent, fk).isEmpty():
        raise ValueError(f"{fk.name} has orphans")
    return {"null_orphans": null_orphans, "delete_orphans": delete_orphans}.get(policy, lambda c, *_: c)(child, parent, fk), report


def aligned(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """child with its key columns in the types of the parent's; a value that does not fit becomes null."""
    kinds = {f.name: f.dataType for f in parent.schema}
    return child.withColumns({c: F.col(c).try_cast(kinds[p]) for c, p in zip(fk.child, fk.parent, strict=True)})


#: One column against a number or a list of literals, in one pair of parentheses at most.
CHECK = re.compile(r"^\s*(\()?\s*(\w+)\s*(?:(>=|<=|>|<)\s*(-?[\d.]+)|in\s*\(([^()]*)\))\s*(?(1)\))\s*$", re.IGNORECASE)


def check_condition(check: str) -> Column | None:
    """The condition of a CHECK constraint of a simple shape; None asks for a person."""
    m = CHECK.match(check)
    return F.expr(f"`{m[2]}` {m[3]} {m[4]}" if m[3] else f"`{m[2]}` in ({m[5]})") if m else None


def check_violations(df: DataFrame, check: str) -> DataFrame:
    """Rows for which the check is false; as in SQL, unknown passes."""
    condition = check_condition(check)
    if condition is None:
        raise ValueError(f"not a simple check: {check}")
    return df.filter(~condition)
