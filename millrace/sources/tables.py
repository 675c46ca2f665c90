"""Sources and sinks by engine: Parquet, JSON, delimited text and JDBC, through Spark's own readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.pivot import to_engine
from ..operators.schemas import missing_columns
from ..operators.shards import Shard
from .delimited import read_text

#: The JDBC URL's beginning of each engine. Fixed values.
JDBC = {"oracle": "jdbc:oracle:thin:@", "mysql": "jdbc:mysql:", "postgresql": "jdbc:postgresql:", "sqlserver": "jdbc:sqlserver:", "db2": "jdbc:db2:"}
FETCH = 5000


def read_table(spark: SparkSession, kind: str, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Files of a kind as a table; columns and predicate reach the scan."""
    df = read_text(spark, path) if kind in ("csv", "tsv") else spark.read.format(kind).load(path)
    df = df.filter(where) if where else df
    return df.select(*(quoted(c) for c in columns)) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, shards: Sequence[Shard] = (), columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A table of a database, a task for each shard."""
    if not url.startswith(tuple(JDBC.values())):
        raise ValueError(f"no engine for {url}")
    properties = {"fetchsize": str(FETCH)} | options
    if key and shards:
        parts = [s.predicate(key) for s in shards]
        parts[0] = f"({parts[0]}) OR {key} IS NULL"
        df = spark.read.jdbc(url, table, predicates=parts, properties=properties)
    else:
        df = spark.read.jdbc(url, table, properties=properties)
    return df.select(*columns) if columns else df


def write_jdbc(df: DataFrame, url: str, table: str, engine: str, types: dict[str, str] | None = None, **options: str) -> None:
    """Adds df to a table of a database, in batches; types are pivot types of columns, for a table that is made."""
    given = {c: to_engine(engine, t)[0] for c, t in (types or {}).items()}
    properties = {"batchsize": str(FETCH)} | ({"createTableColumnTypes": ", ".join(f"{quoted(c, engine)} {t}" for c, t in given.items())} if given else {}) | options
    df.write.jdbc(url, table, mode="append", properties=properties)


def tables_of(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The catalog's tables and columns, a row for each column."""
    rows = [(t.name, c.name, c.dataType, c.nullable, c.isPartition) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name, database)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, is_partition boolean")


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_count) from the footers of Parquet files, a task for some files; no page is read."""
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")  # names only

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for uri in batch.column("file").to_pylist():
                fs, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with fs.open_input_file(name) as f:
                    n.append(pq.ParquetFile(f).metadata.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(n, pa.int64())], names=["file", "row_count"])

    return files.mapInArrow(count, "file string, row_count long")


def sampled_count(df: DataFrame, fraction: float = 0.01) -> DataFrame:
    """One row: an estimate of the number of rows from a sample, for sources without footers."""
    return df.sample(fraction, seed=1).agg((F.count("*") / F.lit(fraction)).cast("long").alias("row_count"))


def append(df: DataFrame, path: str, kind: str = "parquet") -> int:
    """Adds the rows of df to a table and returns how many rows it held before. Appending does not replace them."""
    spark = df.sparkSession
    try:
        there = spark.read.format(kind).load(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    if there is not None and (lacking := missing_columns(df, there)):
        raise ValueError(f"the target lacks {', '.join(lacking)}")
    before = there.count() if there is not None else 0
    df.write.mode("append").format(kind).save(path)
    return before


def replace(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(kind).save(path)


def write_documents(df: DataFrame, path: str) -> None:
    """A JSON document for each row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
