"""Applying a change feed with Structured Streaming.

A micro-batch is reduced to the last change of each key and committed to the target's snapshots with its number and the
high-water mark. Applying a batch again changes nothing, so a restart is safe.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.reconcile import delete_by_keys, latest, upsert
from ..sources.snapshots import Snapshots


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column], op: str | None = None, delete: str = "d", change: str | None = None) -> DataFrame:
    """target after a set of changes: the last of each key counts, deletes remove.

    With `change`, a column of both, a late change does not overwrite a row of the target that is newer. A plain table keeps no
    time of what was deleted; `Snapshots` does.
    """
    last = latest(changes, keys, *order)
    if change:
        newer = target.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max(change).alias("__at"))
        met = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        last = last.join(newer, [*met, F.col("__at") > F.col(change)], "left_anti")
    if op is None:
        return upsert(target, last.select(*target.columns), keys)
    gone = last.filter(F.col(op) == delete)
    return upsert(delete_by_keys(target, gone, keys), last.filter(F.col(op) != delete), keys)


def captured(messages: DataFrame, row: str, value: str = "value", place: str | None = None) -> DataFrame:
    """Change messages (JSON with before, after, op and ts_ms) as rows: the row's columns, op (i, u or d) and ts.

    place: a column with the message's position, such as its offset; kept, it orders changes of one millisecond.
    """
    m = F.from_json(F.col(value).cast("string"), f"before struct<{row}>, after struct<{row}>, op string, ts_ms bigint")
    parts = messages.select(m.alias("m"), *([place] if place else [])).filter("m.op is not null").select(F.when(F.col("m.op") == "d", F.col("m.before")).otherwise(F.col("m.after")).alias("r"), "m.op", "m.ts_ms", *([place] if place else []))
    return parts.select("r.*", *([place] if place else []), F.when(F.col("op") == "d", "d").when(F.col("op") == "u", "u").otherwise("i").alias("op"), F.timestamp_millis("ts_ms").cast("timestamp_ntz").alias("ts"))


def lag(df: DataFrame, change: str, now: Column | None = None) -> DataFrame:
    """One row: seconds since the last change; null, which is not zero, without changes."""
    at = F.unix_seconds((now if now is not None else F.current_timestamp()).cast("timestamp"))
    return df.agg((at - F.unix_seconds(F.max(change).cast("timestamp"))).alias("lag_seconds"))


def run_feed(stream: DataFrame, snapshots: Snapshots, order: Sequence[str], checkpoint: str, op: str | None = None, delete: str = "d") -> DataStreamWriter:
    """A writer that applies each micro-batch; start it with a trigger of choice.

    order: the columns that make up a change's position, in the order of the snapshots' own. The first is the mark. A batch that
    was committed before a restart is not applied again; applying it would change nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        now = snapshots.current()
        if now and now["batch"] is not None and now["batch"] >= number:
            return
        old = now["mark"] if now else None
        mark = batch.agg(F.max(order[0]).cast("string").alias("mark")).first()["mark"]
        gone = F.col(op) == delete if op else None
        keep = [c for c in batch.columns if c != op and (c not in order or c in snapshots.keys or order.index(c) == 0)]
        rows = batch.select(*keep, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *([gone.alias("__g")] if op else []))
        snapshots.apply(rows, [F.col(f"__o{i}") for i in range(len(order))], F.col("__g") if op else None, batch=number, mark=max(filter(None, (mark, old)), default=None))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def every(spark: SparkSession, minutes: float, tick: Callable[[], object], checkpoint: str) -> DataStreamWriter:
    """A writer that calls tick at this interval, 1 minute to a day. A tick that takes longer delays the next; two never overlap in one query."""
    if not 1 <= minutes <= 1440:
        raise ValueError("the interval is 1 to 1440 minutes")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, number: tick()).trigger(processingTime=f"{round(minutes * 60)} seconds").option("checkpointLocation", checkpoint)


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the delay, in bounded state. Late data is an addition of this library."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def wait_until_drained(query: StreamingQuery, rows: int = 0, seconds: float = 3600, poll: float = 1.0) -> bool:
    """Waits until a trigger reads no more than so many rows; false if that takes too long or the query ends."""
    end = time.monotonic() + seconds
    while time.monotonic() < end and query.isActive:
        if drained(query, rows):
            return True
        time.sleep(poll)
    return drained(query, rows)


def drained(query: StreamingQuery, rows: int = 0) -> bool:
    """Whether the last trigger read no more than so many rows; unknown counts as not drained."""
    last = query.lastProgress
    return bool(last) and last["numInputRows"] <= rows
