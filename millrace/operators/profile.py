"""Figures about tables and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nullability(df: DataFrame) -> DataFrame:
    """A row for each column: its nulls, its values, and whether it is nullable. One scan, one pair of aggregates a column."""
    whole = df.agg(F.count("*").alias("__n"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return whole.select("__n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present")) for i, c in enumerate(df.columns)))).alias("x")).select("x.column", "x.present", (F.col("__n") - F.col("x.present")).alias("absent"), (F.col("__n") > F.col("x.present")).alias("nullable"))


def widths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: the longest text and the most digits."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    digits = [F.char_length(F.regexp_replace(t, "[^0-9]", "")) for t in text]
    whole = df.agg(*(F.max(F.char_length(t)).alias(f"w{i}") for i, t in enumerate(text)), *(F.max(d).alias(f"d{i}") for i, d in enumerate(digits)))
    return whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"w{i}").alias("widest"), F.col(f"d{i}").alias("digits")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def sample(df: DataFrame, order: Sequence[str], rows: int = 25, width: int = 200) -> DataFrame:
    """The first rows by key, long text cut."""
    cut = [F.substring(F.col(f"`{f.name}`"), 1, width).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema]
    return df.orderBy(*order).limit(rows).select(*cut)


def throughput(runs: DataFrame, by: Sequence[str], rows: Column, seconds: Column, at: str, failed: Column) -> DataFrame:
    """By pair: runs, the share that failed, and the rate of the last run."""
    rate = F.when(seconds > 0, rows / seconds)
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), (F.sum(failed.cast("int")) / F.count("*")).alias("error_rate"), F.max_by(rate, F.col(at)).alias("last_rate"))


#: The weight of each construct that makes a routine harder to move.
MARKERS = {
    r"\bDBMS_[A-Z_]+": 3, r"\bUTL_[A-Z_]+": 3, "%ROWTYPE": 1, "%TYPE": 1, r"\bPRAGMA\b": 2, r"\bBULK COLLECT\b": 2, r"\bFORALL\b": 2, r"\bAUTONOMOUS_TRANSACTION\b": 3,
    r"\bCONNECT BY\b": 3, r"\bMERGE\b": 1, r"\bCURSOR\b": 1, r"\bEXCEPTION\b": 1, r"\bPACKAGE\b": 2, r"\bGOTO\b": 1,
}


def complexity(text: Column, markers: dict[str, int] = MARKERS) -> Column:
    """The weighted number of markers in a text, in either case."""
    out = F.lit(0)
    for pattern, weight in markers.items():
        out = out + weight * F.regexp_count(text, F.lit(f"(?i){pattern}"))
    return F.coalesce(out, F.lit(0))


#: Hours by kind for what is not automatic; a routine by its score. Fixed values.
HOURS = {"table": 0.25, "view": 0.5, "sequence": 0.1}


def assessment(objects: DataFrame) -> DataFrame:
    """By kind: objects by status, the automatic share in percent and the hours left. objects: (kind, status, score)."""
    hours = F.when(F.col("status") == "AUTOMATIC", 0.0)
    for kind, h in HOURS.items():
        hours = hours.when(F.col("kind") == kind, h)
    hours = hours.when((F.col("kind") == "routine") & (F.col("status") == "MANUAL"), F.when(F.col("score") > 4, 4.0).otherwise(1.0)).otherwise(0.0)
    auto = F.count(F.when(F.col("status") == "AUTOMATIC", True))
    return objects.groupBy("kind").agg(F.count("*").alias("objects"), auto.alias("automatic"), F.count(F.when(F.col("status") == "MANUAL", True)).alias("manual"), F.round(100 * auto / F.count("*"), 1).alias("automatic_percent"), F.round(F.sum(hours), 2).alias("hours"))


def status(issues: DataFrame, key: str) -> DataFrame:
    """The status of each object by its worst issue: error, warning or less. issues: (key, severity)."""
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return issues.groupBy(key).agg(F.when(worst == 2, "MANUAL").when(worst == 1, "AUTOMATIC_WITH_WARNINGS").otherwise("AUTOMATIC").alias("status"))
