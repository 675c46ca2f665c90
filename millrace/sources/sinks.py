"""Sinks that take a table whole or not at all, as a data source whose tasks stage parts and whose driver commits them.

A task writes its rows under a part name of its own, never seen before, so what a lost or failed attempt left is told apart.
Only the names that successful tasks sent are committed: by one transaction of a database, or by one manifest file. Where a
database has a bulk way that not every table or type takes, the first failure of a task sets a latch that all tasks heed, and
rows go by statements from then on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import Folder


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class Target(Protocol):
    """begin, commit and abort run once; put runs in a task and returns its rows. Everything must pickle."""

    def begin(self, columns: Sequence[str]) -> None: ...

    def put(self, part: str, batches: Iterator[pa.RecordBatch]) -> int: ...

    def commit(self, parts: Sequence[Part]) -> None: ...

    def abort(self) -> None: ...


def write(df: DataFrame, target: Target) -> None:
    """Adds the rows of df to the target in one commit; if any task fails for good, the target stays as it was."""
    target.begin(df.columns)
    try:
        source = _source(target)
        df.sparkSession.dataSource.register(source)  # the target is pickled here
        df.write.format(source.name()).mode("append").save()
    except Exception:
        target.abort()
        raise


def _source(target: Target) -> type[DataSource]:
    """The classes are made here so that they reach the tasks by value, with the target."""
    label = f"staged_{uuid.uuid4().hex}"

    class Writer(DataSourceArrowWriter):
        def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
            part = uuid.uuid4().hex
            return Part(part, target.put(part, iterator))

        def commit(self, messages: list[Part | None]) -> None:
            target.commit([m for m in messages if m is not None])

        def abort(self, messages: list[Part | None]) -> None:
            target.abort()

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def writer(self, schema: Any, overwrite: bool) -> Writer:
            return Writer()

    return Source


class Files:
    """Parquet files under a folder that tasks and driver reach. Files count once a manifest names them; `read` heeds only those."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))

    def begin(self, columns: Sequence[str]) -> None:
        self.run = uuid.uuid4().hex

    def put(self, part: str, batches: Iterator[pa.RecordBatch]) -> int:
        fs, root = self._fs()
        fs.create_dir(f"{root}/parts", recursive=True)
        rows, out = 0, None
        with fs.open_output_stream(f"{root}/parts/{part}.parquet") as f:
            for batch in batches:
                out = out or pq.ParquetWriter(f, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        return rows

    def commit(self, parts: Sequence[Part]) -> None:
        fs, root = self._fs()
        fs.create_dir(f"{root}/manifests", recursive=True)
        with fs.open_output_stream(f"{root}/manifests/.{self.run}") as f:
            f.write(json.dumps([p.name for p in parts if p.rows]).encode())
        fs.move(f"{root}/manifests/.{self.run}", f"{root}/manifests/{self.run}")

    def abort(self) -> None:
        """Parts that no manifest names are left to `vacuum`: an attempt may still be writing."""

    def _committed(self, files: Folder) -> list[str]:
        return [p for m in files.names("manifests") for p in json.loads(files.read(f"manifests/{m}"))]

    def read(self, spark: SparkSession) -> DataFrame | None:
        found = self._committed(Folder(spark, self.path))
        return spark.read.parquet(*(f"{self.path}/parts/{p}.parquet" for p in found)) if found else None

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the parts of failed writes while nothing else writes; returns how many."""
        files = Folder(spark, self.path)
        lost = [n for n in files.names("parts") if n.removesuffix(".parquet") not in set(self._committed(files))]
        for n in lost:
            files.delete(f"parts/{n}")
        return len(lost)


class Database:
    """A table of a database, by Python's database interface.

    connect opens a connection, in tasks and driver. bulk(connection, table, columns, rows) is the fast way, if there is one.
    Rows are staged in a table beside the target, with their part's name, and moved in one transaction.
    """

    def __init__(self, connect: Callable[[], Any], table: str, bulk: Callable[[Any, str, Sequence[str], Sequence[tuple]], None] | None = None, mark: str = "?", batch: int = 5000):
        self.connect, self.table, self.bulk, self.mark, self.batch = connect, table, bulk, mark, batch
        self.stage, self.columns = "", []

    def _run(self, *statements: str) -> None:
        con = self.connect()
        try:
            for s in statements:
                con.cursor().execute(s)
            con.commit()
        finally:
            con.close()

    def begin(self, columns: Sequence[str]) -> None:
        self.stage, self.columns = f"{self.table}__{uuid.uuid4().hex[:12]}", list(columns)
        names = ", ".join(columns)
        self._run(f"CREATE TABLE {self.stage} AS SELECT {names}, CAST('' AS VARCHAR(40)) AS part__ FROM {self.table} WHERE 1 = 0", f"CREATE TABLE {self.stage}_latch (why VARCHAR(300))", f"CREATE TABLE {self.stage}_parts (part__ VARCHAR(40))")

    def put(self, part: str, batches: Iterator[pa.RecordBatch]) -> int:
        con = self.connect()
        try:
            cur, rows = con.cursor(), 0
            columns = [*self.columns, "part__"]
            insert = f"INSERT INTO {self.stage} ({', '.join(columns)}) VALUES ({', '.join([self.mark] * len(columns))})"
            for batch in batches:
                values = [(*r, part) for r in zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True)]
                for i in range(0, len(values), self.batch):
                    some = values[i : i + self.batch]
                    if not self._bulked(con, cur, columns, some):
                        cur.executemany(insert, some)
                    con.commit()
                    rows += len(some)
            return rows
        finally:
            con.close()

    def _bulked(self, con: Any, cur: Any, columns: Sequence[str], rows: Sequence[tuple]) -> bool:
        cur.execute(f"SELECT count(*) FROM {self.stage}_latch")
        if not self.bulk or cur.fetchone()[0]:
            return False
        try:
            self.bulk(con, self.stage, columns, rows)
            return True
        except Exception as e:  # noqa: BLE001
            con.rollback()
            cur.execute(f"INSERT INTO {self.stage}_latch VALUES ({self.mark})", (str(e)[:300],))
            con.commit()
            return False

    def commit(self, parts: Sequence[Part]) -> None:
        names = ", ".join(self.columns)
        con = self.connect()
        try:
            cur = con.cursor()
            cur.executemany(f"INSERT INTO {self.stage}_parts VALUES ({self.mark})", [(p.name,) for p in parts])
            cur.execute(f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {self.stage} WHERE part__ IN (SELECT part__ FROM {self.stage}_parts)")
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()
        self.abort()

    def abort(self) -> None:
        self._run(*(f"DROP TABLE IF EXISTS {self.stage}{x}" for x in ("", "_latch", "_parts")))
