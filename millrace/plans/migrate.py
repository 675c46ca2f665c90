"""Moving tables: a dry run, the copy itself, its validation, and several tables in dependency waves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import row_hash
from ..operators.reconcile import checksum, hashed_columns, totals
from ..operators.schemas import missing_columns, waves
from ..sources.tables import append


@dataclass
class Moved:
    table: str
    rows: int
    before: int
    ok: bool
    note: str = ""


def dry_run(source: DataFrame, target: DataFrame | None, table: str) -> DataFrame:
    """One row: rows to move, whether the target exists and what it holds, and warnings."""
    spark = source.sparkSession
    lacking = missing_columns(source, target) if target is not None else []
    out = source.agg(F.lit(table).alias("table"), F.count("*").alias("source_rows"))
    out = out.join(target.agg(F.count("*").alias("rows_before")) if target is not None else spark.range(1).select(F.lit(0).cast("long").alias("rows_before")))  # one row each
    warnings = F.array_compact(F.array(F.when(F.lit(target is None), "the target does not exist"), F.when(F.lit(bool(lacking)), f"the target lacks {', '.join(lacking)}"), F.when(F.col("rows_before") > 0, "the target is not empty: rows are added")))
    return out.withColumns({"target_exists": F.lit(target is not None), "warnings": F.array_join(warnings, "; ")})


def migrate(source: DataFrame, path: str, table: str, convert: Mapping[str, Column] | None = None, kind: str = "parquet") -> Moved:
    """Copies a table, reads it back and compares counts and checksums; the source's are taken while it is written, in one scan."""
    df = source.withColumns(dict(convert)) if convert else source
    seen = Observation()
    names = hashed_columns(df)
    watched = df.withColumn("__h", row_hash(df, names)).observe(seen, *totals()).drop("__h")
    before = append(watched, path, kind)
    there = df.sparkSession.read.format(kind).load(path)
    mine = seen.get
    if before:
        n = there.count()
        return Moved(table, n - before, before, n - before == mine["row_count"], "rows were added to others: counts are compared")
    r = checksum(there.select(*df.columns), names).first().asDict()
    same = all(r[k] == mine[k] for k in r)
    return Moved(table, r["row_count"], 0, same, "" if same else "counts or checksums differ")


def migrate_schema(spark: SparkSession, tables: Iterable[str], references: Mapping[str, Iterable[str]], read: Callable[[str], DataFrame], path: Callable[[str], str], at_once: int = 4) -> list[Moved]:
    """Moves tables, parents first; those of a wave at once, as Spark jobs side by side. One that fails stops no other."""

    @inheritable_thread_target(spark)
    def one(table: str) -> Moved:
        try:
            return migrate(read(table), path(table), table)
        except Exception as e:  # noqa: BLE001
            return Moved(table, 0, 0, False, str(e).splitlines()[0][:300])

    out = []
    for wave in waves(tables, references):
        with ThreadPoolExecutor(at_once) as pool:
            out += pool.map(one, wave)
    return out


def run_batch(jobs: Sequence[tuple[str, Callable[[], list[Moved]]]]) -> dict[str, list[Moved] | str]:
    """Several schemas one after another; a failure is recorded and the next goes on."""
    out: dict[str, list[Moved] | str] = {}
    for name, job in jobs:
        try:
            out[name] = job()
        except Exception as e:  # noqa: BLE001
            out[name] = str(e)
    return out
