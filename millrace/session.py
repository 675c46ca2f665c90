"""Session settings and tables kept in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "millrace", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads all see the same rows."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes():
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    """The scopes open in this thread."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept within the block, by this thread, are deleted at its end; what is to outlive it must be written elsewhere by then."""
    _scopes().append([])
    try:
        yield
    finally:
        conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for p in map(path, _scopes().pop()):
            p.getFileSystem(conf).delete(p, True)
