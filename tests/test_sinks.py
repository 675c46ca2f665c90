"""Sinks: whole or not at all, whatever fails; the bulk way's latch."""

import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources import sinks


class Breaking(sinks.Files):
    """Fails in so many runs, after its tasks wrote."""

    def __init__(self, path, times, at="put"):
        super().__init__(path)
        self.times, self.at, self.counter = times, at, Path(path).parent / "failures"

    def _fail(self, at):
        self.counter.mkdir(exist_ok=True)
        if at == self.at and len({x.name for x in self.counter.iterdir()} | {self.run}) <= self.times:
            (self.counter / self.run).touch()
            raise OSError("lost")

    def put(self, part, batches):
        n = super().put(part, batches)
        if n:
            self._fail("put")
        return n

    def commit(self, parts):
        self._fail("commit")
        super().commit(parts)


@pytest.mark.parametrize("at", ["put", "commit"])
def test_files_are_unchanged_or_complete(spark, tmp_path, at):
    target, rows = Breaking(str(tmp_path / "t"), 2, at), spark.range(100).repartition(3)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            sinks.write(rows, target)
        assert target.read(spark) is None
    sinks.write(rows, target)
    assert sorted(r["id"] for r in target.read(spark).collect()) == list(range(100))
    sinks.write(spark.range(100, 110), target)
    sinks.write(spark.range(0), target)
    assert target.read(spark).count() == 110
    assert target.vacuum(spark) >= 2 and target.read(spark).count() == 110


def connect_to(path):
    return lambda: sqlite3.connect(path, timeout=120)


def test_a_database_takes_all_or_nothing(spark, tmp_path):
    connect = connect_to(str(tmp_path / "db"))
    with connect() as con:
        con.execute("CREATE TABLE t (id INTEGER, v TEXT)")
        con.execute("INSERT INTO t VALUES (-1, 'old')")
    rows = spark.range(50).select("id", F.when(F.col("id") % 7 > 0, F.format_string("it's %d", "id")).alias("v")).repartition(3)
    calls = str(tmp_path / "calls")

    def bulk(con, table, columns, values):  # takes no rows with nulls
        with open(calls, "a") as f:
            f.write("x")
        con.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", values)
        if any(v is None for r in values for v in r):
            raise ValueError("no nulls")

    bad = sinks.Database(connect, "t", batch=5)
    with pytest.raises(Exception, match="bad"):
        sinks.write(rows.withColumn("v", F.when(F.col("id") == 49, F.raise_error(F.lit("bad"))).otherwise(F.col("v"))), bad)
    with connect() as con:
        assert con.execute("SELECT id FROM t").fetchall() == [(-1,)]
    sinks.write(rows, sinks.Database(connect, "t", bulk, batch=5))
    with connect() as con:
        assert sorted(con.execute("SELECT * FROM t").fetchall()) == [(-1, "old"), *((i, f"it's {i}" if i % 7 else None) for i in range(50))]
        assert con.execute("SELECT count(*) FROM sqlite_master").fetchone() == (1,)
    assert len(Path(calls).read_text()) < 9  # of some twelve batches: the latch held
