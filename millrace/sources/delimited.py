"""Delimited text files as tables: every cell is text first, typed by the library's own rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import coerce, infer
from ..functions.names import headers

MAX_FILES = 50
#: The coercion of each inferred kind.
COERCION = {"int": "int", "float": "float", "decimal": "numeric", "bool": "bool", "date": "date", "datetime": "datetime"}


def read_text(spark: SparkSession, paths: str | Sequence[str], header: bool = True, line_breaks: bool = False) -> DataFrame:
    """Cells as text. Short rows are padded, long ones cut, blank rows skipped, a byte order mark eaten; tabs part .tsv.

    line_breaks allows them within quoted cells; Spark then cannot split a file among tasks.
    """
    files = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    if len(files) > MAX_FILES:
        raise ValueError(f"{len(files)} files; {MAX_FILES} at most")
    kinds = {f.lower().endswith(".tsv") for f in files}
    if len(kinds) > 1:
        raise ValueError("comma and tab files cannot be read together")
    raw = spark.read.option("header", header).option("sep", "\t" if kinds == {True} else ",").option("quote", '"').option("escape", '"').option("multiLine", line_breaks).csv(files)
    named = raw.toDF(*headers(raw.columns))
    return named.filter(F.coalesce(*(F.when(F.trim(F.col(f"`{c}`")) != "", True) for c in named.columns)))


def read_typed(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with inferred types, a row for each column: kind, conflict, widest, digits). Types come from all rows."""
    raw = read_text(spark, paths)
    found = infer(raw).collect()  # a row for each column
    cols = [coerce(F.col(f"`{r['column']}`"), COERCION[r["kind"]])["value"].alias(r["column"]) if r["kind"] in COERCION else F.col(f"`{r['column']}`") for r in found]
    return raw.select(*cols), spark.createDataFrame([(r["column"], r["kind"], r["conflict"], r["widest"], r["digits"]) for r in found], "column string, kind string, conflict boolean, widest int, digits int")


def table_names(files: Sequence[str]) -> dict[str, str]:
    """A table name for each file, from its stem; collisions are numbered."""
    stems = [f.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for f in files]
    return dict(zip(files, headers(stems), strict=True))
