"""Repair of graphs of foreign keys against a plain fixed point; ranges of any keys."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import keyranges
from millrace.operators.repair import components, repair_all
from millrace.plans import resume

EDGES = "child string, parent string, child_columns array<string>, parent_columns array<string>"
GRAPH = [("b", "a", ["ref"], ["id"]), ("c", "b", ["ref"], ["id"]), ("c", "c", ["boss"], ["id"]), ("d", "e", ["ref"], ["id"]), ("e", "d", ["boss"], ["id"]), ("e", "a", ["ref"], ["id"]), ("f", "d", ["ref"], ["id"]), ("f", "elsewhere", ["ref"], ["id"])]


def fixed_point(tables):
    left = {t: list(rows) for t, rows in tables.items()}
    at = {"id": 0, "ref": 1, "boss": 2}
    while True:
        before = {t: len(r) for t, r in left.items()}
        for c, p, ck, pk in GRAPH:
            if p in left:
                have = {r[at[pk[0]]] for r in left[p]}
                left[c] = [r for r in left[c] if r[at[ck[0]]] is None or r[at[ck[0]]] in have]
        if before == {t: len(r) for t, r in left.items()}:
            return left


@pytest.mark.parametrize("seed", [3])
def test_repair_reaches_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    some = lambda n: rng.choice([None, *range(n)])
    rows = {t: [(rng.randrange(30), some(36), some(32)) for _ in range(40)] for t in "abcdef"}  # ids repeat: a key lives while one of its rows does
    rows["c"] = [(i, None, i - 1) for i in range(1, 9)]  # a chain whose root lacks its parent
    tables = {t: spark.createDataFrame(r, "id int, ref int, boss int") for t, r in rows.items()}
    clean, report = repair_all(tables, spark.createDataFrame(GRAPH, EDGES))
    want = fixed_point(rows)
    assert {t: Counter(map(tuple, df.collect())) for t, df in clean.items()} == {t: Counter(r) for t, r in want.items()}
    assert want["c"] == [] and len(want["d"]) not in (0, 40)
    assert {r["table"]: (r["row_count"], r["deleted"]) for r in report.collect()} == {t: (len(rows[t]), len(rows[t]) - len(want[t])) for t in rows}


def test_components_come_parents_first():
    assert components(list("fedcba"), [(c, p, tuple(x), tuple(y)) for c, p, x, y in GRAPH]) == [["a"], ["b"], ["c"], ["d", "e"], ["f"]]


def test_ranges_of_skewed_and_composite_keys(spark):
    rows = spark.range(8000).select(F.concat(F.lit("it's "), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string"))).alias("a b"), F.pow("id", 3).cast("long").alias("n"), F.lit(dt.datetime(2024, 1, 1)).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5, dt.datetime(2024, 1, 1)), ("x", None, dt.datetime(2024, 1, 1)), (None, None, None)], "`a b` string, n long, t timestamp"))
    for keys in (["n"], ["a b", "n"], ["t", "a b", "n"]):
        parts = keyranges.ranges(keys, keyranges.cuts_of(rows, keys, 8, sample=4000))
        counts = {r[0]: r[1] for r in rows.groupBy(keyranges.index(rows, parts)).count().collect()}
        assert sorted(counts) == list(range(8)) and max(counts.values()) < 2 * 1000 and sum(counts.values()) == 8003
        assert [rows.filter(p.column()).count() for p in parts[:3]] == [counts[i] for i in range(3)]
        assert sum(rows.filter(p.column()).count() for p in parts) == 8003  # no row in two
    assert keyranges.cuts_of(rows, ["t"], 8) == [] and keyranges.cuts_of(rows.limit(0), ["n"], 8) == []


def test_predicates_for_databases(spark):
    import duckdb

    rows = [(a, b) for a in ("it's", "b", "c", None) for b in (1, 2, 3, None)]
    parts = keyranges.ranges(["a", "b"], [("b", 2), ("it's", 1), ("it's", 3)])
    con = duckdb.connect()
    con.execute("create table t (a varchar, b int)")
    con.executemany("insert into t values (?, ?)", rows)
    got = [con.execute(f"select * from t where {p.predicate('postgresql')}").fetchall() for p in parts]
    assert Counter(x for g in got for x in g) == Counter(rows)
    df = spark.createDataFrame(rows, "a string, b int")
    assert [Counter(g) for g in got] == [Counter(map(tuple, df.filter(p.column()).collect())) for p in parts]
    assert set(got[1]) == {("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3)}


def test_a_copy_goes_on_by_the_cuts_it_began_with(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("k%05d", F.col("id") * F.col("id")).alias("k"), F.col("id").alias("v"))
    parts = keyranges.planned(rows, ["k"], 4, str(tmp_path / "p"))
    resume.copy_shards(rows, None, parts[:2], str(tmp_path / "c"))
    more = rows.unionByName(spark.range(300, 600).select(F.lit("k9").alias("k"), F.col("id").alias("v")))
    again = keyranges.planned(more, ["k"], 4, str(tmp_path / "p"))
    assert again == parts
    done = resume.copy_shards(more, None, again, str(tmp_path / "c"))
    assert resume.combined(done)["row_count"] == 600 and spark.read.parquet(*(x["folder"] for x in done)).count() == 600
