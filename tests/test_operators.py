"""The library's operators, exhaustively over small ranges and on hard rows."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import cells, dialect, names, pivot
from millrace.functions.canonical import row_hash
from millrace.operators import hierarchy, integrity, nested, profile, reconcile, schemas, shards
from millrace.plans import migrate, resume, sync
from millrace.sources import delimited, tables
from millrace.streaming import feed

SCHEMA = "id int, big_id bigint, amount decimal(10,2), label string, when_day timestamp_ntz, notes string, optional string, always_null string"
LABELS = ["plain", "it's", 'say "x"', "back`tick", "a; -- b", "zażółć"]


@pytest.fixture(scope="module")
def conformance(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i + 1, 10_000_000_000 + i, round(1234.56 + i, 2), LABELS[i % 6], day + dt.timedelta(days=i), None if i % 3 == 0 else "n" * 5000, None if i % 4 == 0 else f"opt-{i}", None) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA.replace("decimal(10,2)", "double")).withColumn("amount", F.col("amount").cast("decimal(10,2)"))


def one(df):
    return df.first().asDict()


def test_checksum_is_independent_of_order_and_adds_up_over_shards(conformance):
    whole = one(reconcile.checksum(conformance))
    assert one(reconcile.checksum(conformance.orderBy(F.desc("id")).repartition(7))) == whole
    parts = reconcile.checksum(conformance, by=[(F.col("id") % 5).alias("s")]).withColumn("t", F.lit("t"))
    assert {k: v for k, v in one(reconcile.combine_checksums(parts, ["t"])).items() if k != "t"} == whole
    assert one(reconcile.checksum(conformance.limit(0))) == {"row_count": 0, "hash_xor": 0, "hash_sum": 0}
    assert one(reconcile.checksum(conformance.unionByName(conformance)))["hash_sum"] != whole["hash_sum"]


def test_canonical_values(spark):
    def h(value, kind):
        return spark.range(1).select(F.lit(value).cast(kind).alias("v")).select(row_hash(spark.range(1).select(F.lit(value).cast(kind).alias("v")))).first()[0]

    assert h("a  ", "string") == h("a", "string") != h("a\t", "string")
    assert h(1, "int") == h(1, "bigint") == h(True, "boolean")
    assert h("2024-01-01", "date") == h("2024-01-01", "timestamp_ntz")
    assert h(None, "string") != h("", "string")
    assert h("1.50", "decimal(10,2)") == h("1.5", "decimal(10,1)")
    two = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "a"), ("a", None)], "x string, y string")
    assert two.select(row_hash(two).alias("h")).distinct().count() == 4


def test_validate_finds_one_changed_row(conformance):
    assert one(reconcile.validate(conformance, conformance))["same_content"]
    changed = conformance.withColumn("label", F.when(F.col("id") == 7, "x").otherwise(F.col("label")))
    assert not one(reconcile.validate(conformance, changed))["same_content"]


def test_sync_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a "), (2, "b"), (3, "c"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (None, "n")], "k int, v string")
    assert {(r.k, r.action) for r in reconcile.diff(s, t, ["k"]).collect()} == {(2, "update"), (4, "insert"), (3, "delete")}
    after = reconcile.apply_diff(s, t, ["k"])
    assert reconcile.diff(s, after, ["k"]).count() == 0 and sorted(map(str, after.collect())) == sorted(map(str, s.collect()))
    assert {r.k for r in reconcile.upsert(t, s, ["k"]).collect()} == {1, 2, 3, 4, None}
    assert reconcile.diff(s, t.limit(0), ["k"]).count() == 4


def test_padded_text_keys_meet(spark):
    a, b = spark.createDataFrame([("x  ",)], "k string"), spark.createDataFrame([("x",)], "k string")
    assert reconcile.diff(a, b, ["k"]).count() == 0 and reconcile.keys_missing(b, a, ["k"]).count() == 0


def test_marks_are_inclusive_and_plain(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2, 5, 0, 0, 1200))], "id int, ts timestamp_ntz")
    assert reconcile.since(e, "ts", "2024-01-01 05:00:00").count() == 2
    assert one(reconcile.next_mark(e, "ts")) == {"mark": "2024-01-02 05:00:00.001200"}
    assert one(reconcile.next_mark(e.filter("id = 1"), "ts")) == {"mark": "2024-01-01 05:00:00"}
    assert one(reconcile.next_mark(e.limit(0), "ts", "old")) == {"mark": "old"}


def test_strategies(spark):
    s = spark.createDataFrame([], "id int, name string, created timestamp, last_updated timestamp, modified_by string").schema
    assert sync.plan_sync(s).strategy == "SKIP"
    assert sync.plan_sync(s, ["id"]).change == "last_updated"
    assert sync.plan_sync(s, [], [["name"]]).keys == ("name",)
    assert sync.plan_sync(spark.createDataFrame([], "id int, updated_by string").schema, ["id"]).strategy == "COMPARE"


@given(st.integers(-500, 500), st.integers(0, 400), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_every_key_is_in_one_shard(low, span, n):
    found = shards.shards_of(low, low + span, n)
    assert len(found) <= max(1, min(n, span + 1))
    for k in range(low - 3, low + span + 4):
        assert sum((s.low is None or k >= s.low) and (s.high is None or k < s.high) for s in found) == 1


def test_shard_plans_give_reasons(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    assert len(shards.plan(df, ["id"], 4, 10)[0]) == 4
    assert "fewer" in shards.plan(df, ["id"], 4)[1] and "integer" in shards.plan(df, ["s"], 4, 10)[1] and "single" in shards.plan(df, ["id", "s"])[1]


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(9)
    got = shards.numbered(df, ["k"]).orderBy("k").collect()
    assert [r.row_no for r in got] == list(range(1, 1001)) and [r.k for r in got] == sorted(r.k for r in got)


FK = integrity.ForeignKey("fk", ["a", "b"], ["x", "y"])


def test_orphans_and_repairs(spark):
    child = spark.createDataFrame([(1, 1, "ok"), (1, 2, "lost"), (None, 2, "null"), (1, None, "null")], "a int, b int, c string")
    parent = spark.createDataFrame([(1, 1), (2, 2), (1, 1)], "x int, y int")
    assert [r.c for r in integrity.orphans(child, parent, FK).collect()] == ["lost"]
    assert one(integrity.diagnose(child, parent, FK)) == {"fk": "fk", "orphan_rows": 1, "child_rows": 4, "parent_rows": 3, "parent_looks_empty": False}
    assert one(integrity.diagnose(child, parent.limit(0), FK))["parent_looks_empty"]
    fixed = {(r.a, r.b, r.c) for r in integrity.repair(child, parent, FK, "null_orphans")[0].collect()}
    assert fixed == {(1, 1, "ok"), (None, None, "lost"), (None, 2, "null"), (1, None, "null")}
    kept, report = integrity.repair(child, parent, FK, "delete_orphans")
    assert kept.count() == 3 and one(report)["rows_changed"] == 1
    assert integrity.repair(child, parent, FK)[0].count() == 4
    with pytest.raises(ValueError):
        integrity.repair(child, parent, FK, "stop")


def test_checks(spark):
    df = spark.createDataFrame([(1,), (50,), (None,)], "n int")
    assert [r.n for r in integrity.check_violations(df, "(n <= 40)").collect()] == [50]
    assert integrity.check_violations(df, "N IN (1, 50)").count() == 0
    assert integrity.check_condition("n > 1 and n < 5") is None and integrity.check_condition("(n > 1") is None


def test_nested(spark):
    df = spark.createDataFrame([(1, ("x", (2.0,)), [("s", 1), ("t", None)], [1, 2]), (2, None, [], None)], "_id int, addr struct<city: string, geo: struct<lat: double>>, items array<struct<sku: string, qty: int>>, tags array<int>")
    flat = nested.flatten(df)
    assert flat.columns == ["_id", "addr.city", "addr.geo.lat", "items", "tags"] and flat.first()["addr.geo.lat"] == 2.0
    assert nested.child_table(df, "items", "_id", "items_id").columns == ["items_id", "_id", "qty", "sku"]
    assert [tuple(r) for r in nested.child_table(df, "tags", "_id", "tags_id").orderBy("tags_id").collect()] == [(1, 1, 1), (2, 1, 2)]
    with pytest.raises(ValueError):
        nested.child_table(spark.createDataFrame([(1, [[1]])], "_id int, m array<array<int>>"), "m", "_id", "m_id")
    kinds = spark.createDataFrame([("5",), ("3000000000",), ("1.5",), ("true",), ('"x"',), ("{}",), ("[]",), ("null",), (None,)], "v string")
    assert [r[0] for r in kinds.select(nested.kind_of(F.col("v"))).collect()] == ["int", "long", "double", "bool", "string", "object", "array", "null", "missing"]


CELLS = {"": "null", " ": "null", None: "null", "Yes": "bool", "false": "bool", "01234": "string", "-7": "int", "+5": "int", "1.5": "float", ".5": "float", "1e3": "float", "nan": "string", "2024-3-7": "date", "2024-13-01": "string", "2024-02-30": "string", "2024-03-07 09:30": "datetime", "2024-03-07T09:30:15": "datetime", "03/07/2024": "string", "07:30": "time", "25:00": "string", "N/A": "string", "0": "int", "0.5": "float"}


def test_cells(spark):
    df = spark.createDataFrame([(k,) for k in CELLS], "v string")
    got = {r.v: r.k for r in df.select("v", cells.kind_of(F.col("v")).alias("k")).collect()}
    assert got == CELLS
    combos = {("int", "float"): "float", ("int", "decimal"): "decimal", ("date", "datetime"): "datetime", ("int", "string"): "string", ("null",): "null", ("bool", "null"): "bool", ("date", "time"): "string"}
    for k, want in combos.items():
        assert spark.range(1).select(cells.combined(F.array(*map(F.lit, k)))).first()[0] == want
    c = df.select("v", cells.coerce(F.col("v"), "numeric").alias("c"))
    got = {r.v: (None if r.c["value"] is None else float(r.c["value"]), r.c["bad"]) for r in c.collect()}
    assert got["Yes"] == (1, None) and got["N/A"] == (None, "N/A") and got[""] == (None, None) and got["1e3"] == (1000, None)


def test_names():
    assert names.headers(["a b", "A_B", None, "1x", "--"]) == ["a_b", "A_B_2", "column_3", "_1x", "column_5"]
    assert names.sanitize("é--x y!") == "x_y" and len(names.fitted("n" * 80, 30)) == 30 and names.fitted("n", 30) == "n"
    assert names.quoted("a`b") == "`a``b`"


def test_pivot_types():
    assert pivot.to_spark("number(5, 0)")[0].simpleString() == "int" and pivot.to_spark("NUMBER(40)")[1]
    assert pivot.to_spark("TIMESTAMP(6) WITH LOCAL TIME ZONE")[0].simpleString() == "timestamp" and pivot.to_spark("WHAT")[1]
    assert pivot.from_engine("mysql", "int(11) unsigned") == ("NUMBER(10)", "unsigned is dropped")
    assert pivot.from_engine("mysql", "tinyint(1)")[0] == "BOOLEAN" and pivot.from_engine("postgresql", "numeric(12,3)")[0] == "NUMBER(12,3)"
    assert pivot.from_engine("sqlserver", "nvarchar(max)")[0] == "CLOB" and pivot.from_engine("postgresql", "hstore")[1]


def test_target_types():
    assert pivot.to_engine("postgresql", "NUMBER(9)")[0] == "INTEGER" and pivot.to_engine("mysql", "NUMBER(12,2)")[0] == "DECIMAL(12,2)"
    assert pivot.to_engine("sqlserver", "VARCHAR2(30)")[0] == "NVARCHAR(30)" and pivot.to_engine("db2", "CLOB")[0] == "CLOB" and pivot.to_engine("postgresql", "NUMBER") == ("NUMERIC", "no precision")
    assert pivot.from_engine("db2", "decimal(9,2)")[0] == "NUMBER(9,2)" and pivot.from_engine("mongodb", "objectId")[0] == "ROWID"
    assert names.quoted("a]b", "sqlserver") == "[a]]b]"


def test_copies_go_on_where_they_stopped(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    cut = shards.shards_of(0, 99, 4)
    resume.copy_shards(df, "id", cut[:2], str(tmp_path / "c"))
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("part-*") if "shard=0" in str(p)}
    whole = resume.combined(resume.copy_shards(df, "id", cut, str(tmp_path / "c")))
    assert first == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("part-*") if "shard=0" in str(p)}
    assert whole == one(reconcile.checksum(df))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("Connection reset by peer")
        return 7

    assert resume.retried(flaky, sleep=lambda _: None) == 7
    with pytest.raises(ValueError):
        resume.retried(lambda: (_ for _ in ()).throw(ValueError("wrong type")), sleep=lambda _: None)


def test_dialect_dates(spark):
    def v(c):
        return spark.range(1).select(c).first()[0]

    d = lambda x: F.lit(x).cast("timestamp_ntz")
    assert v(dialect.date_diff("yy", d("2023-12-31"), d("2024-01-01"))) == 1
    assert v(dialect.date_diff("hh", d("2024-01-01 00:59:00"), d("2024-01-01 01:00:00"))) == 1
    assert v(dialect.date_diff("wk", d("2024-01-06"), d("2024-01-07"))) == 1
    assert str(v(dialect.add_months(F.lit("2024-02-29").cast("date"), 1))) == "2024-03-31"
    assert str(v(dialect.add_months(F.lit("2024-01-31").cast("date"), 1))) == "2024-02-29"
    assert v(dialect.instr(F.lit("banana"), F.lit("an"), 1, 2)) == 4 and v(dialect.instr(F.lit("banana"), F.lit("x"), 1, 2)) == 0
    assert v(dialect.decode(F.lit(None), F.lit(None), F.lit("x"), F.lit("y"))) == "x"
    assert v(dialect.length(F.lit("ab  "))) == 2 and v(dialect.concat(F.lit("a"), F.lit(None))) == "a"
    assert dialect.pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss" and v(dialect.trunc_number(F.lit(-1.29), 1)) == -1.2


def test_schemas_and_profiles(spark):
    w = schemas.waves(["a", "b", "c", "d", "e"], {"b": ["A", "b", "outside"], "c": ["b"], "d": ["e"], "e": ["d"]})
    assert w == [["a"], ["b"], ["c"], ["d", "e"]]
    assert schemas.subset(["a", "b"], {"b": ["a"]}, ["B"]) == (["b"], [("b", "a")])
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r.column: r.nullable for r in profile.nullability(df).collect()} == {"a": False, "b": True}
    text = spark.createDataFrame([("package p cursor x; dbms_output.put r%rowtype",), (None,)], "t string")
    assert [r[0] for r in text.select(profile.complexity(F.col("t"))).collect()] == [7, 0]


def test_delimited_files(spark, tmp_path):
    p = tmp_path / "people.csv"
    p.write_bytes("﻿id,zip,when,size\n1,01234,2024-3-7,5\n2,02115,2024-03-08 10:00\n,,,\n3,00001,,N/A,extra\n".encode())
    df, found = delimited.read_typed(spark, str(p))
    assert [tuple(r)[:2] for r in df.orderBy("id").collect()] == [(1, "01234"), (2, "02115"), (3, "00001")]
    assert {r.column: (r.kind, r.conflict) for r in found.collect()} == {"id": ("int", False), "zip": ("string", False), "when": ("datetime", False), "size": ("string", True)}
    assert delimited.table_names(["/x/a.csv", "/y/a.csv"]) == {"/x/a.csv": "a", "/y/a.csv": "a_2"}
    with pytest.raises(ValueError):
        delimited.read_text(spark, [f"{i}.csv" for i in range(51)])


def test_migration(spark, conformance, tmp_path):
    path = str(tmp_path / "t")
    assert one(migrate.dry_run(conformance, None, "t"))["source_rows"] == 60
    moved = migrate.migrate(conformance, path, "t")
    assert moved.ok and moved.rows == 60 and moved.before == 0
    again = migrate.migrate(conformance, path, "t")
    assert again.ok and again.before == 60
    assert "not empty" in one(migrate.dry_run(conformance, spark.read.parquet(path), "t"))["warnings"]
    with pytest.raises(ValueError):
        tables.append(conformance.withColumn("new", F.lit(1)), path)
    result = migrate.migrate_schema(spark, ["child", "parent", "bad"], {"child": ["parent"]}, lambda t: spark.range(5) if t != "bad" else spark.read.parquet("/nowhere"), lambda t: str(tmp_path / t))
    assert {m.table: m.ok for m in result} == {"parent": True, "child": True, "bad": False}
    assert tables.read_table(spark, "parquet", path, ["id"], "id <= 10").count() == 20
    tables.write_documents(conformance.select("id", "optional"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 60


def test_feed_applies_each_change_once(spark, tmp_path):
    src, out = tmp_path / "in", feed.Snapshots(spark, str(tmp_path / "out"), ["id"], "ts timestamp_ntz")
    schema = "id int, v string, ts timestamp_ntz, op string"

    def put(rows):
        spark.createDataFrame([(i, v, dt.datetime(2024, 1, d), op) for i, v, d, op in rows], schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        q = feed.run_feed(spark.readStream.schema(schema).parquet(str(src)), out, ["ts"], str(tmp_path / "cp"), "op").trigger(availableNow=True).start()
        q.awaitTermination(120)

    put([(1, "a", 1, "i"), (1, "b", 3, "u"), (2, "x", 1, "i"), (3, "y", 2, "i")])
    run()
    assert {(r.id, r.v) for r in out.read().collect()} == {(1, "b"), (2, "x"), (3, "y")}
    put([(2, None, 5, "d"), (4, "z", 4, "i")])
    run()
    run()
    assert {(r.id, r.v) for r in out.read().collect()} == {(1, "b"), (3, "y"), (4, "z")}
    assert out.current()["mark"] == "2024-01-05 00:00:00"


def test_checksums_tell_odd_numbers_apart(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, 0.0, 1e33, -1e33, 1.7e308, 2e15, 12.3456785]
    frames = [spark.createDataFrame([(v,)], "x double") for v in odd]
    assert len({one(reconcile.checksum(f))["hash_xor"] for f in frames}) == len(odd)
    assert one(reconcile.validate(frames[0], frames[3]))["same_content"] is False


def test_repeated_target_keys_are_replaced_once(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y")], "id long, v string")
    got = sorted((r.id or 0, r.v) for r in reconcile.upsert(target, new, ["id"]).collect())
    assert got == [(0, "d"), (1, "x"), (2, "c"), (3, "y")]
    assert sorted((r.id, r.v) for r in reconcile.apply_diff(new, target, ["id"]).collect()) == [(1, "x"), (3, "y")]


def test_numbers_are_cut_in_decimals(spark):
    rows = spark.createDataFrame([(4.35,), (0.29,), (-4.359,), (1e30,), (None,)], "x double")
    assert [r[0] for r in rows.select(dialect.trunc_number(F.col("x"), 2)).collect()] == [4.35, 0.29, -4.35, 1e30, None]
    assert rows.limit(1).select(dialect.trunc_number(F.lit(1234.5), -2)).first()[0] == 1200.0


@given(st.text("AB", max_size=8), st.text("AB", min_size=1, max_size=2), st.integers(-6, -1), st.integers(1, 3))
@settings(max_examples=12, deadline=None)
def test_instr_backwards(spark, text, part, start, nth):
    got = spark.range(1).select(dialect.instr(F.lit(text), F.lit(part), start, nth)).first()[0]
    places = [p for p in range(len(text) + start + 1, 0, -1) if text[p - 1 : p - 1 + len(part)] == part]
    assert got == (places[nth - 1] if len(places) >= nth else 0)


def test_date_parts_and_masks(spark):
    t = F.lit("2024-03-10 11:12:13.456789").cast("timestamp_ntz")
    parts = spark.range(1).select(*(dialect.date_part(p, t).cast("long").alias(p) for p in ("dy", "dw", "ms", "mcs", "qq", "wk"))).first().asDict()
    assert parts == {"dy": 70, "dw": 1, "ms": 456, "mcs": 456789, "qq": 1, "wk": 10}
    later = spark.range(1).select(dialect.date_add("ms", 5, t).cast("string"), dialect.date_add("dy", 1, t).cast("string"), dialect.date_diff("mcs", t, dialect.date_add("ms", 5, t))).first()
    assert tuple(later) == ("2024-03-10 11:12:13.461789", "2024-03-11 11:12:13.456789", 5000)
    assert dialect.pattern("RRRR-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss" and dialect.pattern("ddTmonth") == "dd'T'MMMM"


def test_late_changes_and_ties_in_a_feed(spark):
    cols = "id int, v string, ts timestamp_ntz"
    day = lambda d: dt.datetime(2024, 1, d)
    target = spark.createDataFrame([(1, "new", day(9)), (2, "old", day(1))], cols)
    changes = spark.createDataFrame([(1, "late", day(5), "u", 1), (2, "b", day(3), "u", 7), (2, "a", day(3), "u", 6), (3, "z", day(2), "i", 2)], f"{cols}, op string, place long")
    got = feed.apply_changes(target, changes, ["id"], [F.col("ts"), F.col("place")], "op", change="ts")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "new"), (2, "b"), (3, "z")]
    message = spark.createDataFrame([('{"op": "c", "after": {"id": 1}, "ts_ms": 5}', 42)], "value string, offset long")
    assert one(feed.captured(message, "id int", place="offset"))["offset"] == 42


def test_tables_of_a_scope_are_deleted(spark):
    import os

    from millrace.session import kept, scratch

    with scratch(spark):
        path = kept(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_jdbc_options_and_predicates(spark, monkeypatch):
    from pyspark.sql import DataFrameReader, DataFrameWriter

    calls = []
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, **kw: calls.append((url, table, kw)) or spark.range(1))
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, url, table, **kw: calls.append((url, table, kw)))
    cut = shards.shards_of(1, 2_000_000, 2)
    tables.read_jdbc(spark, "jdbc:postgresql://h/d", "t", "id", cut, user="u")
    _, _, kw = calls[-1]
    assert len(kw["predicates"]) == len(cut) and kw["predicates"][0].endswith("OR id IS NULL") and kw["properties"] == {"fetchsize": "5000", "user": "u"}
    tables.read_jdbc(spark, "jdbc:mysql://h/d", "t")
    assert "predicates" not in calls[-1][2]
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:h2:mem", "t")
    tables.write_jdbc(spark.range(1), "jdbc:mysql://h/d", "t", "mysql")
    assert calls[-1][2]["mode"] == "append" and calls[-1][2]["properties"]["batchsize"] == "5000"


def test_schemas_are_synchronised_in_waves_with_marks(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    cols, state = "id int, v string, updated_at timestamp_ntz", {}
    source = {"parent": [(1, "a", day(1)), (2, "b", day(5))], "child": [(1, "x", day(3))], "bad": []}
    target = {"parent": [(1, "old", day(1)), (3, "c", day(1))], "child": [(1, "x", day(3))]}
    frame = lambda rows: spark.createDataFrame(rows, cols)
    plans = {t: sync.plan_sync(frame([]).schema, ["id"]) for t in source}

    def read(t):
        if t == "bad":
            raise ValueError("no such table")
        return frame(source[t])

    done = sync.sync_schema(plans, {"child": ["parent"]}, read, lambda t: frame(target[t]), lambda t, df: state.update({t: sorted((r.id, r.v) for r in df.collect())}), {"parent": "2024-01-02 00:00:00", "bad": "2020-01-01 00:00:00"})
    assert [x.table for x in done].index("parent") < [x.table for x in done].index("child")
    by = {x.table: x for x in done}
    assert state == {"parent": [(1, "old"), (2, "b")], "child": [(1, "x")]}
    assert by["parent"].mark == "2024-01-05 00:00:00" and by["parent"].counts == {"insert": 1, "delete": 1}
    assert not by["bad"].ok and by["bad"].mark == "2020-01-01 00:00:00"


def test_shapes_are_merged(spark):
    docs = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5, "d": [{"e": 1}, {"f": true}]}',), ("no json",), (None,), ('{"b": {"c": null, "odd key: >": 1}}',)], "j string")
    got = {r.path: r.kind for r in nested.merged_shape(docs, "j").collect()}
    assert got["b.c"] == "STRING" and got["d"] == "ARRAY" and got["d[]"] == "OBJECT" and got["d[].e"] == "BIGINT" and got["d[].f"] == "BOOLEAN" and got["b.odd key: >"] == "BIGINT" and got["a"].startswith(("DECIMAL", "DOUBLE"))
    assert nested.merged_shape(docs.limit(0), "j").count() == 0


def test_footers_are_counted(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "f"))
    assert tables.footer_counts(spark, str(tmp_path / "f")).agg(F.sum("row_count")).first()[0] == 1000
    assert 700 < tables.sampled_count(spark.range(10_000), 0.1).first()[0] < 13_000


def test_partition_plans_have_buckets_or_reasons():
    plan, why = shards.partition_plan("RANGE", ["d"], {"p1": "TO_DATE(' 2020-01-01 00:00:00', 'SYYYY-MM-DD HH24:MI:SS')", "p2": "MAXVALUE"})
    assert why == "" and [(b.name, b.upper) for b in plan] == [("p1", "2020-01-01 00:00:00"), ("p2", None)]
    plan, _ = shards.partition_plan("LIST", ["c"], {"a": "'x, y', 'z'", "rest": "DEFAULT"})
    assert plan[0].values == ("x, y", "z") and plan[1].default
    for args, word in ((("HASH", ["c"], {}), "HASH"), (("RANGE", ["a", "b"], {}), "2 columns"), (("RANGE", ["a"], {"p": "f(x)"}), "not understood"), (("RANGE", ["a"], {"p": "5", "q": "3"}), "rise"), (("RANGE", ["a"], {}, True), "partitions of")):
        plan, why = shards.partition_plan(*args)
        assert plan is None and word in why


def test_subsets_drop_what_leads_outside():
    t, triggers, views, dropped = schemas.subset_objects(["a", "b", "c"], {"a": ["c", "b"]}, ["A", "b"], {"t1": "a", "t2": "C"}, {"v": ["a"], "w": ["c"], "u": ["W", "a"]})
    assert (t, triggers, views) == (["a", "b"], ["t1"], ["v"])
    assert {(d.kind, d.name) for d in dropped} == {("reference", "a to c"), ("trigger", "t2"), ("view", "w"), ("view", "u")}


def test_defaults_and_regexp_places(spark):
    row = spark.range(1)
    for text, kind, want in (("'it''s'", "string", "it's"), ("Active", "string", "Active"), ("((0))", "int", 0), ("b'1'", "boolean", True), ("'n'", "boolean", False), ("1.5", "double", 1.5)):
        value, why = dialect.default_value(text, kind)
        assert why == "" and row.select(value).first()[0] == want
    assert row.select(dialect.default_value("getdate()", "timestamp")[0]).first()[0] is not None
    for text, kind, word in ((None, "int", "no default"), ("NULL", "int", "no default"), ("0000-00-00 00:00:00", "timestamp", "zeros"), ("newid()", "string", "not known"), ("maybe", "boolean", "no boolean")):
        value, why = dialect.default_value(text, kind)
        assert value is None and word in why
    places = row.select(*(dialect.regexp_instr(F.lit("ab12cd345e6"), "[0-9]+", n).alias(str(n)) for n in (1, 2, 3, 4))).first()
    assert tuple(places) == (3, 7, 11, 0)


def test_percent_masks_type_names_and_numbers(spark):
    assert dialect.percent_pattern("%Y-%m-%dT%H:%i:%s.%f %% at %q o'x") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS % 'at' 'q' 'o''x'"
    assert dialect.pattern("DD of YYYY") == "dd 'of' yyyy"
    t = F.lit("2024-03-09 15:04:05.000678").cast("timestamp_ntz")
    shown = lambda m: spark.range(1).select(dialect.date_format(t, m)).first()[0]
    assert shown("%W %a %b %M %e %c %k %l %p %j %T %f") == "Saturday Sat Mar March 9 3 15 3 PM 069 15:04:05 000678"
    assert tuple(spark.range(1).select(dialect.str_to_date(F.lit("09/03/24"), "%d/%m/%y").cast("string"), dialect.str_to_date(F.lit("x"), "%d")).first()) == ("2024-03-09 00:00:00", None)
    numbers = [dialect.to_number(F.lit(x), m) for x, m in ((" 12.5 ", None), ("x", None), ("1,234.50", "FM9G999D00"), ("$7", "L9"), ("12", "9"))]
    assert [None if v is None else float(v) for v in spark.range(1).select(*numbers).first()] == [12.5, None, 1234.5, 7.0, None]
    made = [dialect.convert(k, F.lit(x)) for k, x in (("nvarchar(max)", "a" * 40), ("varchar", "a" * 40), ("decimal(5, 2)", "1.239"), ("money", "1.5"), ("bit", 1), ("int", "q"), ("NUMERIC", "7.6"))]
    assert [str(v) for v in spark.range(1).select(*made).first()] == ["a" * 40, "a" * 30, "1.24", "1.5000", "True", "None", "8"]
    with pytest.raises(ValueError):
        dialect.convert("geometry", F.lit(1))
