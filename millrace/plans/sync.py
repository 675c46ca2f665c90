"""Planning and running an incremental synchronisation of a table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconcile import apply_diff, diff, keys_missing, next_mark, select_by_keys, since, upsert
from ..operators.schemas import waves
from ..session import kept
from ..sources.files import Lease
from ..sources.snapshots import Snapshots

#: Names of columns that hold the time of the last change, the most trusted first.
CHANGE_NAMES = [
    r"^(last_)?updated?(_at|_on|_date|_time|_ts)?$",
    r"^(last_)?modified?(_at|_on|_date|_time|_ts)?$",
    r"^(date|time)_(updated|modified|changed)$",
    r"^(last_)?changed(_at|_on)?$",
    r"^row_version$|^rowversion$|^version_ts$",
]
#: A fixed value too: parts of such names.
LOOSE = "updat|modif|chang"
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class SyncPlan:
    strategy: str  # SKIP, TIMESTAMP or COMPARE
    keys: tuple[str, ...]
    change: str | None
    reason: str


def change_column(schema: T.StructType) -> str | None:
    names = [f.name for f in schema if isinstance(f.dataType, TEMPORAL)]
    for p in (*CHANGE_NAMES, None):
        for n in names:
            if re.search(p or LOOSE, n.lower()):
                return n
    return None


def plan_sync(schema: T.StructType, primary: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> SyncPlan:
    keys = tuple(primary) or next((tuple(u) for u in unique if u), ())
    if not keys:
        return SyncPlan("SKIP", (), None, "no key")
    change = change_column(schema)
    return SyncPlan("TIMESTAMP", keys, change, f"rows since the mark by {change}") if change else SyncPlan("COMPARE", keys, None, "no change column: rows are compared")


def sync(source: DataFrame, target: DataFrame, plan: SyncPlan, mark: str | None = None, deletes: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the next target, counts by action, the next mark). Deletes are found by key whatever the strategy."""
    spark = target.sparkSession
    if plan.strategy == "SKIP":
        return target, spark.createDataFrame([], "action string, row_count long"), spark.createDataFrame([(mark,)], "mark string")
    if plan.strategy == "COMPARE":
        changes = diff(source, target, plan.keys, deletes=deletes)
        after = apply_diff(source, target, plan.keys, deletes)
        new = spark.createDataFrame([(mark,)], "mark string")
    else:
        fresh = since(source, plan.change, mark)
        changes = diff(fresh, target, plan.keys, deletes=False)
        after = upsert(target, fresh, plan.keys)
        if deletes:
            gone = kept(keys_missing(target, source, plan.keys).select(*plan.keys), "gone")
            changes = changes.unionByName(gone.withColumn("action", F.lit("delete")))
            after = keys_missing(target, fresh.select(*plan.keys).unionByName(gone), plan.keys).unionByName(fresh.select(*target.columns))
        new = next_mark(fresh, plan.change, mark)
    return after, changes.groupBy("action").agg(F.count("*").alias("row_count")), new


@dataclass
class Synced:
    table: str
    ok: bool
    mark: str | None
    counts: dict[str, int]
    note: str = ""


def sync_schema(tables: Mapping[str, SyncPlan], references: Mapping[str, Iterable[str]], read: Callable[[str], DataFrame], target: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None], marks: Mapping[str, str | None], deletes: bool = True) -> list[Synced]:
    """Synchronises several tables, parents first, each from its own mark. A table that fails keeps its mark and stops no other.

    write(table, rows) commits a table's next state; it must not overwrite what `target` reads from.
    """
    out = []
    for table in (t for wave in waves(list(tables), references) for t in wave):
        mark = marks.get(table)
        try:
            after, counts, new = sync(read(table), target(table), tables[table], mark, deletes)
            found = {r["action"]: r["row_count"] for r in counts.collect()}  # a row for each action
            next_ = new.first()["mark"]
            if tables[table].strategy != "SKIP":
                write(table, after)
            out.append(Synced(table, True, next_, found, tables[table].reason))
        except Exception as e:  # noqa: BLE001
            out.append(Synced(table, False, mark, {}, str(e).splitlines()[0][:300]))
    return out


#: The position of a row in a synchronised table: the version that brought it.
POSITION = "version long"


def commit(source: DataFrame, store: Snapshots, plan: SyncPlan, deletes: bool = True) -> tuple[str | None, dict[str, int]]:
    """Brings the store up to the source's state, rows, deletions and mark in one commit; returns the mark and counts by action.

    A run that dies before the commit leaves the old version and the old mark, so the next does the same work again.
    """
    now = store.current()
    mark, target = (now["mark"], store.read(now)) if now else (None, None)
    target = target if target is not None else source.limit(0)
    fresh = since(source, plan.change, mark) if plan.strategy == "TIMESTAMP" else source
    changes = diff(fresh, target, plan.keys, target.columns, deletes=False)
    if deletes:
        changes = changes.unionByName(keys_missing(target, source, plan.keys).select(*plan.keys).withColumn("action", F.lit("delete")))
    changes = kept(changes, "changes")
    rows = select_by_keys(fresh, changes.filter("action <> 'delete'"), plan.keys).select(*target.columns).withColumn("__g", F.lit(False))
    if deletes:
        rows = rows.unionByName(select_by_keys(target, changes.filter("action = 'delete'"), plan.keys).withColumn("__g", F.lit(True)))
    new = next_mark(fresh, plan.change, mark).first()["mark"] if plan.strategy == "TIMESTAMP" else mark
    version = (now["version"] if now else 0) + 1
    store.apply(rows, [F.lit(version)], F.col("__g"), mark=new, floor=json.dumps({"version": version}))
    return new, {r["action"]: r["count"] for r in changes.groupBy("action").count().collect()}  # a row for each action


def tick(stores: Mapping[str, Snapshots], plans: Mapping[str, SyncPlan], references: Mapping[str, Iterable[str]], read: Callable[[str], DataFrame], lease: Lease, deletes: bool = True) -> list[Synced] | None:
    """One run of a scheduled synchronisation, parents first. None, and nothing is done, while another run holds the lease.

    Each table's mark is committed with its rows. A table that fails keeps its mark and stops no other. `streaming.feed.every` calls this.
    """
    if not lease.take():
        return None
    out = []
    try:
        for table in (t for wave in waves(list(stores), references) for t in wave):
            if plans[table].strategy == "SKIP":
                out.append(Synced(table, True, None, {}, plans[table].reason))
                continue
            try:
                out.append(Synced(table, True, *commit(read(table), stores[table], plans[table], deletes), plans[table].reason))
            except Exception as e:  # noqa: BLE001
                old = stores[table].current()
                out.append(Synced(table, False, old and old["mark"], {}, str(e).splitlines()[0][:300]))
    finally:
        lease.release()
    return out
