"""Steering a run of many tables: pause, go on, cancel one table or all, and a pool of the scheduler for each table.

A table's work runs in a thread of its own. Its Spark jobs bear a tag, by which they are cancelled without those of other
tables, and run in a pool named after the table, so that with spark.scheduler.mode=FAIR a small table does not wait for a
large one. Between groups of shards a table asks whether it may go on; what it has done by then is in its manifest, so a
paused or cancelled copy goes on from there in the same run or in a later one.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators.keyranges import KeyRange
from ..operators.schemas import waves
from ..operators.shards import Shard
from .resume import combined, copy_shards, done


class Cancelled(RuntimeError):
    """The table, or the run, was cancelled."""


class Run:
    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"run-{uuid.uuid4().hex[:12]}"
        self._go = threading.Event()
        self._go.set()
        self._cancelled: set[str] = set()
        self._all = False

    def pause(self) -> None:
        """Tables stop before their next group of shards; jobs under way end."""
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self, table: str | None = None) -> None:
        """Ends a table's jobs and its work, or the whole run's. A paused table ends at once."""
        if table is None:
            self._all = True
        else:
            self._cancelled.add(table)
        for t in [table] if table else [self.tag]:
            self.spark.sparkContext.cancelJobsWithTag(f"{self.tag}-{t}" if table else t)

    def _gone(self, table: str) -> bool:
        return self._all or table in self._cancelled

    def check(self, table: str) -> None:
        """Called between groups: waits while the run is paused, and raises if the table is to end."""
        while not self._gone(table) and not self._go.wait(0.2):
            pass
        if self._gone(table):
            raise Cancelled(table)

    @contextmanager
    def table(self, name: str) -> Iterator[None]:
        """Jobs of this thread within the block belong to the table."""
        sc, tags = self.spark.sparkContext, (self.tag, f"{self.tag}-{name}")
        for t in tags:
            sc.addJobTag(t)
        sc.setLocalProperty("spark.scheduler.pool", name)
        try:
            yield
        finally:
            for t in tags:
                sc.removeJobTag(t)
            sc.setLocalProperty("spark.scheduler.pool", None)


def copy_tables(run: Run, tables: Iterable[str], references: Mapping[str, Iterable[str]], read: Callable[[str], DataFrame], plan: Callable[[str], tuple[str | None, Sequence[Shard | KeyRange]]], path: Callable[[str], str], at_once: int = 4, group: int = 8) -> dict[str, dict | str]:
    """Copies tables in groups of shards, parents first, those of a wave side by side.

    Returns for each table its rows and checksum, or why it has none: "cancelled", or the error. What is copied stays for the next run.
    """

    def one(table: str) -> dict | str:
        try:
            with run.table(table):
                key, shards = plan(table)
                df = read(table)
                for i in range(group, len(shards) + group, group):
                    run.check(table)
                    copy_shards(df, key, shards[:i], path(table), at_once=group)
                return combined(list(done(df, path(table)).values()))
        except Cancelled:
            return "cancelled"
        except Exception as e:  # noqa: BLE001
            return "cancelled" if run._gone(table) else str(e).splitlines()[0][:300]

    out: dict[str, dict | str] = {}
    for wave in waves(tables, references):
        with ThreadPoolExecutor(at_once) as pool:
            # wrapped for each table: threads of one wrapper would share their tags
            found = {t: pool.submit(inheritable_thread_target(run.spark)(one), t) for t in wave}
        out |= {t: f.result() for t, f in found.items()}
    return out
