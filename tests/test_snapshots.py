"""Snapshots: positions decide, whatever the order; commits hold or leave everything; buckets split; old versions go."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans import sync
from millrace.sources.files import Folder, Lease
from millrace.sources.snapshots import Conflict, Snapshots
from millrace.streaming import feed

CHANGE = "id int, v string, at long, place long, gone boolean"


def put(spark, store, changes, **state):
    rows = spark.createDataFrame(changes, CHANGE)
    return store.apply(rows.select("id", "v", F.col("at").alias("__a"), F.col("place").alias("__p"), F.col("gone").alias("__g")), [F.col("__a"), F.col("__p")], F.col("__g"), **state)


def content(store):
    return sorted(map(tuple, store.read().collect()))


def by_hand(load, changes, upto=None):
    best = {i: ((-1, -1), v, False) for i, v in load}
    for i, v, at, place, gone in changes:
        if (at, place) > best.get(i, ((-2,),))[0]:
            best[i] = ((at, place), v, gone)
    return sorted((i, v) for i, (_, v, gone) in best.items() if not gone)


@pytest.mark.parametrize("seed", [2])
def test_any_interleaving_of_load_and_changes_gives_one_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    load = [(i, f"load{i}") for i in range(25)]
    changes = [(rng.randrange(35), f"v{k}", 100 + k // 2, k % 2, rng.random() < 0.35) for k in range(80)]
    want = by_hand(load, changes)
    store = Snapshots(spark, str(tmp_path / "s"), ["id"], "at long, place long", bucket_rows=20, max_deltas=3, keep=3)
    pieces = [("load", load[:12]), ("load", load[12:])] + [("feed", changes[k : k + 14]) for k in range(0, 80, 14)]
    pieces.append(pieces[3])  # once more
    rng.shuffle(pieces)
    store.begin_load({"at": 99, "place": 0})
    for kind, rows in pieces:
        if kind == "load":
            store.load(spark.createDataFrame(rows, "id int, v string"))
        else:
            rows = list(rows)
            rng.shuffle(rows)
            put(spark, store, rows)
    assert content(store) == want
    with pytest.raises(ValueError):
        store.drain({"at": 200, "place": 0})
    store.end_load()
    store.drain({"at": 200, "place": 0})
    assert content(store) == want
    assert store.entries().filter("__gone").count() == 0 and store.current()["deltas"] == []
    dead = next(i for i in range(35) if i not in dict(want))
    put(spark, store, [(dead, "from before its deletion", 100, 0, False)])  # comes too late
    assert content(store) == want
    put(spark, store, [(dead, "back", 300, 0, False)])
    assert content(store) == sorted([*want, (dead, "back")])
    with pytest.raises(ValueError):
        store.begin_load({"at": 150, "place": 0})
    names = Folder(spark, str(tmp_path / "s"))
    assert len(names.names("_versions")) == 3


def test_buckets_split_and_only_touched_ones_are_rewritten(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), ["id"], "at long", bucket_rows=60)
    rows = spark.range(1000).select("id", F.lit("a").alias("v"))
    store.apply(rows, [F.lit(1)])
    store.compact(force=True)
    buckets = store._buckets(store.current())
    assert len(buckets) >= 16 and sum(b["rows"] for b in buckets) == 1000 and max(b["rows"] for b in buckets) <= 120
    store.apply(spark.createDataFrame([(7, "b")], "id long, v string"), [F.lit(2)])
    store._rewrite(store.current(), False)
    after = {b["name"]: b["folder"] for b in store._buckets(store.current())}
    assert sum(after.get(b["name"]) != b["folder"] for b in buckets) == 1
    assert store.read().filter("v = 'b'").collect()[0]["id"] == 7 and store.read().count() == 1000
    old = store.current()
    store.apply(rows.limit(0), [F.lit(3)], mark="m")
    assert store.current()["mark"] == "m" and store.read(old).count() == 1000


def test_a_thousand_commits_leave_few_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), ["id"], "at long", keep=4)
    for n in range(12):
        store.apply(spark.range(n, n + 5).select("id", F.lit(n).alias("n")), [F.lit(n)], batch=n)
    for n in range(12, 1000):
        store.note(batch=n)
    files, now = Folder(spark, str(tmp_path / "s")), store.current()
    assert now["batch"] == 999 and files.names("_versions")[-1] == f"{now['version']:015d}" and len(files.names("_versions")) == 4
    assert len(now["deltas"]) <= 9 and len(files.names()) <= 2 + len(now["deltas"])
    assert sorted((r["id"], r["n"]) for r in store.read().collect()) == [(i, min(i, 11)) for i in range(16)]


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path / "s"), ["id"], "at long") for _ in range(2))
    now = a.note(mark="1")
    b._point(now, mark="2")
    with pytest.raises(Conflict):
        a._point(now, mark="3")
    assert a.current()["mark"] == "2"


def test_a_tick_killed_before_its_commit_is_repeated(spark, tmp_path, monkeypatch):
    day = lambda d: dt.datetime(2024, 1, d)
    source = {"t": [(1, "a", day(1)), (2, "b", day(2)), (3, "c", day(3))], "u": [(1, "x", day(1))]}
    schema = "id int, v string, updated_at timestamp_ntz"
    plans = {"t": sync.plan_sync(spark.createDataFrame([], schema).schema, ["id"]), "u": sync.SyncPlan("COMPARE", ("id",), None, "rows are compared")}
    stores = {t: Snapshots(spark, str(tmp_path / t), ["id"], sync.POSITION) for t in plans}
    read = lambda t: spark.createDataFrame(source[t], schema)
    lease = Lease(spark, str(tmp_path))
    run = lambda: sync.tick(stores, plans, {"u": ["t"]}, read, lease)
    first = {x.table: x for x in run()}
    assert first["t"].counts == {"insert": 3} and first["t"].mark == "2024-01-03 00:00:00" and first["u"].counts == {"insert": 1}
    source["t"] = [(1, "a", day(1)), (3, "C", day(5)), (4, "d", day(3))]
    source["u"] = [(1, "y", day(1)), (2, "z", day(1))]
    point = Snapshots._point

    def dies(self, now, **changes):
        if self is stores["t"]:
            raise RuntimeError("killed")
        return point(self, now, **changes)

    monkeypatch.setattr(Snapshots, "_point", dies)
    killed = {x.table: x for x in run()}
    assert not killed["t"].ok and killed["t"].mark == "2024-01-03 00:00:00" and killed["u"].counts == {"insert": 1, "update": 1}
    assert [r[1] for r in content(stores["t"])] == ["a", "b", "c"]
    monkeypatch.setattr(Snapshots, "_point", point)
    again = {x.table: x for x in run()}
    assert again["t"].counts == {"insert": 1, "update": 1, "delete": 1} and stores["t"].current()["mark"] == again["t"].mark == "2024-01-05 00:00:00"
    assert [r[:2] for r in content(stores["t"])] == [(1, "a"), (3, "C"), (4, "d")] and [r[:2] for r in content(stores["u"])] == [(1, "y"), (2, "z")]
    assert {x.table: x.counts for x in run()} == {"t": {}, "u": {}}


def test_a_tick_is_skipped_while_another_runs(spark, tmp_path):
    mine, other = Lease(spark, str(tmp_path)), Lease(spark, str(tmp_path))
    assert mine.take() and not other.take()
    assert sync.tick({}, {}, {}, None, other) is None
    mine.release()
    assert sync.tick({}, {}, {}, None, other) == []
    dead = Lease(spark, str(tmp_path), seconds=-1)
    assert dead.take() and mine.take() and not other.take()
    dead.release()  # no longer its own
    assert not other.take()


def test_ticks_are_driven_by_a_trigger(spark, tmp_path):
    import time

    ticks = []
    with pytest.raises(ValueError):
        feed.every(spark, 0.5, lambda: None, str(tmp_path))
    query = feed.every(spark, 1, lambda: ticks.append(1), str(tmp_path / "cp")).start()
    try:
        end = time.monotonic() + 60
        while not ticks and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert ticks
