"""A copy in shards that can go on where it was stopped.

Shards are written to folders of their own, overwritten on a second try, and count once their lines are in the manifest. So a
copy that is run again moves only what is missing. Checksums of another algorithm are dropped, the progress stays.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import checksum, hashed_columns
from ..operators.keyranges import KeyRange
from ..operators.shards import Shard

ALGORITHM = "md5-60/1"
ATTEMPTS, FIRST, LONGEST, AT_ONCE = 3, 0.5, 8.0, 64
#: Parts of messages of errors that may pass. Fixed values.
TRANSIENT = (
    "connection reset", "connection refused", "connection reset by peer", "timeout", "timed out", "deadlock", "lock wait", "try again", "temporary failure", "broken pipe",
    "server closed the connection", "connection already closed", "could not connect", "network error", "connection is closed", "connection lost", "server has gone away",
    "communication link failure", "closed the connection", "not connected to database", "dpy-4011", "dpy-1001", "connection is lost",
)


def copy_id(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def retried(step: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> object:
    """step(), again after a pause while its error may pass."""
    for n in range(attempts):
        try:
            return step()
        except Exception as e:  # noqa: BLE001
            if n + 1 == attempts or not any(t in str(e).lower() for t in TRANSIENT):
                raise
            sleep(min(LONGEST, FIRST * 2**n))


def done(df: DataFrame, path: str) -> dict[str, dict]:
    """The manifest's shards."""
    try:
        lines = df.sparkSession.read.text(f"{path}/_manifest").collect()  # a line for each shard
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {x["shard"]: x for x in (json.loads(r["value"]) for r in lines)}


def copy_shards(df: DataFrame, key: str | None, shards: Sequence[Shard | KeyRange], path: str, at_once: int = AT_ONCE) -> list[dict]:
    """Copies the shards that are missing under path and returns the manifest: rows and checksum of each shard.

    One scan writes `at_once` shards, each to a folder of its own, and one job checks them; so a stopped copy loses that many.
    Shards are ranges of `key`, or ranges of any columns from `keyranges.planned`, which need no key.
    """
    spark, there = df.sparkSession, done(df, path)
    missing = [(i, s) for i, s in enumerate(shards) if s.name not in there]
    for start in range(0, len(missing), at_once):
        some = missing[start : start + at_once]
        index = F.lit(None).cast("int")
        for i, s in reversed(some):
            met = s.column() if isinstance(s, KeyRange) else F.expr(f"({s.predicate(key)})" + (f" OR {key} IS NULL" if i == 0 else ""))
            index = F.when(met, i).otherwise(index)
        part = df.withColumn("__shard", index).filter("__shard IS NOT NULL")
        folder = f"{path}/group={some[0][0]}-{some[-1][0]}"
        retried(lambda part=part, folder=folder: part.write.mode("overwrite").partitionBy("__shard").parquet(folder))
        wrote = spark.read.schema(part.schema).parquet(folder)
        sums = {r["__shard"]: r.asDict() for r in checksum(wrote, hashed_columns(df), ["__shard"]).collect()}  # a row for each shard
        none = {"row_count": 0, "hash_xor": 0, "hash_sum": 0}
        lines = [{"shard": s.name, "folder": f"{folder}/__shard={i}", "algorithm": ALGORITHM} | {k: sums.get(i, none)[k] for k in none} for i, s in some]
        spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{path}/_manifest")
        there |= {x["shard"]: x for x in lines}
    return [x if x["algorithm"] == ALGORITHM else {k: v for k, v in x.items() if not k.startswith("hash_")} for x in there.values()]


def combined(manifest: Sequence[dict]) -> dict:
    """Rows and checksum of the whole; None where a shard lacks one."""
    xor, total = 0, 0
    known = all("hash_xor" in x for x in manifest)
    for x in manifest if known else ():
        xor, total = xor ^ x["hash_xor"], total + x["hash_sum"]
    return {"row_count": sum(x["row_count"] for x in manifest), "hash_xor": xor if known else None, "hash_sum": total if known else None}
