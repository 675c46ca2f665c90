"""Steered runs: pause, go on, cancel one table while another goes on, and go on later."""

import threading
import time

from pyspark.sql import functions as F

from millrace.functions.canonical import row_hash
from millrace.operators.shards import shards_of
from millrace.plans.control import Run, copy_tables
from millrace.plans.resume import done


def parts(_):
    return "id", shards_of(0, 399, 4)


def test_pause_holds_tables_between_groups(spark, tmp_path):
    run, df, out = Run(spark), spark.range(400), {}
    run.pause()
    worker = threading.Thread(target=lambda: out.update(copy_tables(run, ["a", "b"], {}, lambda t: df, parts, lambda t: str(tmp_path / t), group=2)))
    worker.start()
    time.sleep(1.5)
    assert worker.is_alive() and not out and done(df, str(tmp_path / "a")) == {}
    run.resume()
    worker.join(120)
    assert {t: r["row_count"] for t, r in out.items()} == {"a": 400, "b": 400} and out["a"] == out["b"]


def test_one_table_is_cancelled_and_goes_on_later(spark, tmp_path):
    import pandas as pd

    @F.pandas_udf("long")
    def slow(x: pd.Series) -> pd.Series:
        time.sleep(25)
        return x

    run, out = Run(spark), {}
    frames = {"quick": spark.range(400), "stuck": spark.range(400).select(F.when(F.col("id") < 200, F.col("id")).otherwise(slow("id")).alias("id")), "last": spark.range(400)}
    worker = threading.Thread(target=lambda: out.update(copy_tables(run, frames, {"last": ["quick"]}, frames.__getitem__, parts, lambda t: str(tmp_path / t), group=1)))
    worker.start()
    end = time.monotonic() + 60
    while len(done(frames["quick"], str(tmp_path / "quick"))) < 2 and time.monotonic() < end:
        time.sleep(0.3)
    began = time.monotonic()
    run.cancel("stuck")
    worker.join(100)
    assert out["quick"]["row_count"] == 400, out
    assert not worker.is_alive() and time.monotonic() - began < 22
    assert out["stuck"] == "cancelled" and out["quick"]["row_count"] == out["last"]["row_count"] == 400
    frames["stuck"] = spark.range(400)
    again = copy_tables(Run(spark), ["stuck"], {}, frames.__getitem__, parts, lambda t: str(tmp_path / t))
    assert again["stuck"] == out["quick"]


def test_a_cancelled_run_does_nothing_more(spark, tmp_path):
    run = Run(spark)
    run.cancel()
    assert copy_tables(run, ["a", "b"], {"b": ["a"]}, lambda t: spark.range(4), parts, lambda t: str(tmp_path / t)) == {"a": "cancelled", "b": "cancelled"}


def test_nested_values_are_canonical(spark):
    def h(sql):
        df = spark.sql(f"SELECT {sql} AS x")
        return df.select(row_hash(df)).first()[0]

    assert h("map('a', 1.50d, 'b', 2d)") == h("map('b', 2.0d, 'a', 1.5000000001d)") != h("map('a', 2d, 'b', 1.5d)")
    assert h("array(named_struct('d', date'2024-01-01', 't', 'x  '))") == h("array(named_struct('d', timestamp'2024-01-01 00:00:00', 't', 'x'))")
    assert len({h("array('a', 'b')"), h("array('ab')"), h("array('a', null)"), h("cast(array() as array<string>)"), h("cast(null as array<string>)")}) == 5
