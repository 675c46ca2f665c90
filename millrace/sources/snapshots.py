"""A keyed table that grows by changes: base buckets, deltas and one versioned pointer.

Each change has a position (of a log: time, sequence number, offset). What a key is follows from the change with the highest
position alone, so changes may come in any order, late, twice, and mixed with a bulk load, whose rows have the position that
was recorded before it began. Deletions are kept as rows (tombstones) until `drain` says that nothing older can come any more;
from then on older changes are refused.

A commit writes one delta and then the pointer: a small file that names the deltas, the list of buckets, the batch and the mark
of the source, so state and mark cannot part. The driver reads one pointer, whatever the number of batches. Deltas are merged
as they grow, smaller ones into larger ones; when they hold a share of the table, the buckets that they touch are rewritten.
Buckets are split by further bits of the key's hash when they outgrow `bucket_rows` (extendible hashing), so a task of a
rewrite stays bounded. Versions before the last `keep` are removed with the files that only they name.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconcile import latest
from .files import Folder

SHARE = 4  # deltas that hold more than a 1/SHARE of the base's rows are put into it
MASK = (1 << 62) - 1


class Conflict(RuntimeError):
    """Another writer committed the next version first."""


class Snapshots:
    """position: the fields of a position, the most significant first, as a schema, such as "at timestamp_ntz, place long"."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], position: str, bucket_rows: int = 1_000_000, max_deltas: int = 8, keep: int = 8):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.position = T.StructType.fromDDL(position)
        self.bucket_rows, self.max_deltas, self.keep = bucket_rows, max_deltas, keep
        self.files = Folder(spark, path)
        self._lists: dict[str, list[dict]] = {}

    # --- pointers ---

    def current(self) -> dict | None:
        """The newest version: its batch, mark and the files that it consists of. None if nothing was ever committed."""
        names = self.files.names("_versions")
        return json.loads(self.files.read(f"_versions/{names[-1]}")) if names else None

    def _point(self, now: dict | None, **changes: object) -> dict:
        first = {"batch": None, "mark": None, "floor": None, "load": None, "schema": None, "deltas": [], "base": None, "base_rows": 0}
        new = (now or first) | changes | {"version": (now["version"] if now else 0) + 1}
        if not self.files.create(f"_versions/{new['version']:015d}", json.dumps(new)):
            raise Conflict(f"version {new['version']} of {self.path} is taken")
        names = self.files.names("_versions")
        if old := names[: -self.keep]:
            states = {n: json.loads(self.files.read(f"_versions/{n}")) for n in names}
            live = set().union(*(self._named(states[n]) for n in names[-self.keep :]))
            for n in old:
                for f in self._named(states[n]) - live:
                    self.files.delete(f)
                self.files.delete(f"_versions/{n}")
        return new

    def _named(self, state: dict) -> set[str]:
        """The files of a version."""
        return {f for f, _ in state["deltas"]} | ({state["base"]} if state["base"] else set()) | {f"{b['folder']}/__bucket={b['name']}" for b in self._buckets(state) if b["folder"]}

    def _buckets(self, state: dict) -> list[dict]:
        """Of the base: name, depth (bits of the hash), bits, folder (None if empty) and rows."""
        if not state["base"]:
            return [_bucket(0, 0)]
        if state["base"] not in self._lists:
            self._lists = {k: v for k, v in self._lists.items() if len(self._lists) < 4 * self.keep} | {state["base"]: json.loads(self.files.read(state["base"]))}
        return self._lists[state["base"]]

    # --- rows ---

    def _schema(self, state: dict) -> T.StructType:
        own = T.StructType.fromJson(state["schema"])
        return T.StructType([*own.fields, T.StructField("__pos", self.position), T.StructField("__gone", T.BooleanType()), T.StructField("__hash", T.LongType())])

    def _latest(self, entries: DataFrame) -> DataFrame:
        """The entry of each key with the highest position; of equal positions a deletion, else the one with the highest hash."""
        rest = [c for c in entries.columns if c not in self.keys and not c.startswith("__")]
        return latest(entries, self.keys, F.col("__pos"), F.col("__gone"), F.xxhash64(*rest) if rest else F.lit(0))

    def _deltas(self, state: dict) -> DataFrame:
        return self.spark.read.schema(self._schema(state)).parquet(*(f"{self.path}/{f}" for f, _ in state["deltas"]))

    def _base(self, state: dict, names: set[str] | None = None) -> DataFrame:
        """The base's rows, or those of some buckets. A folder all of whose buckets are wanted is one path."""
        schema, by = self._schema(state), {}
        for b in self._buckets(state):
            if b["folder"] and (names is None or b["name"] in names):
                by.setdefault(b["folder"], []).append(b)
        out = self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{f}/__bucket={b['name']}" for f, bs in by.items() for b in bs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else out

    def _placed(self, df: DataFrame, buckets: list[dict], **facts: Sequence) -> DataFrame:
        """df with facts about the bucket of each row. The directory has a row for each value of as many bits as the deepest bucket uses."""
        deepest = max(b["depth"] for b in buckets)
        rows = []
        for i, b in enumerate(buckets):
            rows += [(s, *(f[i] for f in facts.values())) for s in range(b["bits"], 1 << deepest, 1 << b["depth"])]
        kinds = {str: "string", int: "int"}
        directory = self.spark.createDataFrame(rows, ", ".join(["__slot long", *(f"{n} {kinds[type(f[0])]}" for n, f in facts.items())]))
        return df.withColumn("__slot", F.col("__hash").bitwiseAND(F.lit((1 << deepest) - 1))).join(F.broadcast(directory), "__slot").drop("__slot")

    def _dirty(self, state: dict) -> dict[str, int]:
        """Rows of the deltas by bucket."""
        buckets = self._buckets(state)
        placed = self._placed(self._deltas(state).select("__hash"), buckets, __name=[b["name"] for b in buckets])
        return {r["__name"]: r["count"] for r in placed.groupBy("__name").count().collect()}  # a row for each bucket

    def entries(self, state: dict | None = None) -> DataFrame | None:
        """One row for each key, deleted ones included. Buckets without deltas are read as they are."""
        now = state or self.current()
        if not now or not now["schema"]:
            return None
        if not now["deltas"]:
            return self._base(now)
        dirty = set(self._dirty(now))
        met = self._latest(self._base(now, dirty).unionByName(self._deltas(now)))
        clean = {b["name"] for b in self._buckets(now)} - dirty
        return met.unionByName(self._base(now, clean)) if clean else met

    def read(self, state: dict | None = None) -> DataFrame | None:
        """The table as of the current version, or of one that `current` gave; None if it has no columns yet."""
        found = self.entries(state)
        return None if found is None else found.filter("NOT __gone").drop("__pos", "__gone", "__hash")

    # --- changes ---

    def apply(self, rows: DataFrame, position: Sequence[Column], gone: Column | None = None, **state: object) -> dict:
        """Commits changes: rows with their position and whether they delete their key; with them batch, mark or floor."""
        now = self.current()
        at = F.struct(*(p.cast(f.dataType).alias(f.name) for p, f in zip(position, self.position, strict=True)))
        return self._put(now, rows, at, gone, bool(now and now["floor"]), **state)

    def _at(self, position: Mapping[str, object] | None) -> Column:
        """A position as a literal; without one, that before all others."""
        return F.from_json(F.lit(json.dumps(position or {}, default=str)), self.position)

    def _put(self, now: dict | None, rows: DataFrame, at: Column, gone: Column | None, late: bool, **state: object) -> dict:
        own = T.StructType.fromJson(now["schema"]) if now and now["schema"] else None
        rows = rows.withColumns({"__pos": at, "__gone": F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False), "__hash": F.xxhash64(*(F.col(f"`{k}`").cast("string") for k in self.keys)).bitwiseAND(F.lit(MASK))})
        rows = rows.select(*(own or T.StructType([f for f in rows.schema if not f.name.startswith("__")])).names, "__pos", "__gone", "__hash")
        if late:
            rows = rows.filter(F.col("__pos") > self._at(json.loads(now["floor"])))
        folder = f"delta-{uuid.uuid4().hex}"
        self._latest(rows).write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()  # from the footers
        deltas = (now["deltas"] if now else []) + ([[folder, n]] if n else [])
        if not n:
            self.files.delete(folder)
        schema = own or T.StructType([f for f in rows.schema if not f.name.startswith("__")])
        new = self._point(now, schema=schema.jsonValue(), deltas=deltas, **state)
        return self.compact() if len(deltas) > self.max_deltas else new

    def note(self, **state: object) -> dict:
        """Commits a batch or a mark without rows."""
        return self._point(self.current(), **state)

    # --- load and feed ---

    def begin_load(self, start: Mapping[str, object] | None = None) -> dict:
        """Before a bulk load is read. start: the feed's position by now; all later changes must have higher ones."""
        now = self.current()
        if now and now["load"] is not None:
            raise ValueError("a load is going on")
        if now and now["floor"] and not self.spark.range(1).select(self._at(start) >= self._at(json.loads(now["floor"]))).first()[0]:
            raise ValueError("the load would begin before what was drained")
        return self._point(now, load=json.dumps(dict(start or {}), default=str))

    def load(self, rows: DataFrame) -> dict:
        """Rows of the load, all or some; the feed's changes may come before, between or after them, and win."""
        now = self.current()
        if not now or now["load"] is None:
            raise ValueError("no load was begun")
        return self._put(now, rows, self._at(json.loads(now["load"])), None, False)

    def end_load(self) -> dict:
        return self._point(self.current(), load=None)

    def drain(self, upto: Mapping[str, object]) -> dict:
        """Nothing at or before this position can come any more: deletions up to there are forgotten, older changes refused."""
        now = self.current()
        if now["load"] is not None:
            raise ValueError("the load has not ended")
        self._point(now, floor=json.dumps(dict(upto), default=str))
        return self.compact(force=True)

    # --- upkeep ---

    def compact(self, force: bool = False) -> dict:
        """Merges deltas; puts them into the base where they are a share of it or `force` is set."""
        now = self.current()
        sizes = [n for _, n in now["deltas"]]
        if not force and sum(sizes) * SHARE <= max(now["base_rows"], self.bucket_rows):
            first, merged = len(sizes) - 1, sizes[-1]
            while first and 2 * merged >= sizes[first - 1]:
                first -= 1
                merged += sizes[first]
            first = min(first, len(sizes) - 2)
            folder = f"delta-{uuid.uuid4().hex}"
            some = self.spark.read.schema(self._schema(now)).parquet(*(f"{self.path}/{f}" for f, _ in now["deltas"][first:]))
            self._latest(some).write.parquet(f"{self.path}/{folder}")
            n = self.spark.read.parquet(f"{self.path}/{folder}").count()
            return self._point(now, deltas=[*now["deltas"][:first], [folder, n]])
        return self._rewrite(now, force)

    def _rewrite(self, now: dict, force: bool) -> dict:
        if not now["schema"]:
            return now
        buckets = self._buckets(now)
        dirty = self._dirty(now) if now["deltas"] else {}
        touched = {b["name"] for b in buckets if b["name"] in dirty or force}
        depths = [b["depth"] + (max(0, math.ceil(math.log2((b["rows"] + dirty.get(b["name"], 0)) / self.bucket_rows))) if b["name"] in touched and b["rows"] + dirty.get(b["name"], 0) else 0) for b in buckets]
        rows = self._base(now, touched)
        rows = self._latest(rows.unionByName(self._deltas(now))) if now["deltas"] else rows
        if now["floor"] and now["load"] is None:
            rows = rows.filter(~(F.col("__gone") & (F.col("__pos") <= self._at(json.loads(now["floor"])))))
        rows = self._placed(rows, buckets, __depth=depths)
        rows = rows.withColumn("__bucket", F.format_string("d%db%d", "__depth", F.col("__hash").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__depth")) - 1))).drop("__depth")
        folder = f"base-{uuid.uuid4().hex}"
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        wrote = self.spark.read.schema(T.StructType([*self._schema(now).fields, T.StructField("__bucket", T.StringType())])).parquet(f"{self.path}/{folder}")
        counts = {r["__bucket"]: r["count"] for r in wrote.groupBy("__bucket").count().collect()}  # a row for each bucket
        new = [b for b in buckets if b["name"] not in touched]
        for b, depth in zip(buckets, depths, strict=True):
            if b["name"] in touched:
                for bits in range(b["bits"], 1 << depth, 1 << b["depth"]):
                    made = _bucket(depth, bits)
                    n = counts.get(made["name"], 0)
                    new.append(made | {"folder": folder if n else None, "rows": n})
        listed = f"_buckets/{uuid.uuid4().hex}"
        self.files.create(listed, json.dumps(new))
        return self._point(now, deltas=[], base=listed, base_rows=sum(b["rows"] for b in new))


def _bucket(depth: int, bits: int) -> dict:
    return {"name": f"d{depth}b{bits}", "depth": depth, "bits": bits, "folder": None, "rows": 0}
