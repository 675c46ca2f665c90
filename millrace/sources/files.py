"""Small files on the file system that driver and executors share, through Hadoop's client: pointers, lists, leases."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Names are relative to the folder. Writers create a file once: it is written aside and renamed when complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What the folder of that name holds, sorted; nothing if there is none."""
        at = self._at(name)
        found = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(f for f in found if not f.startswith("."))

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if there is a file of that name already, which stays as it is."""
        at, aside = self._at(name), self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(at) and self._fs.rename(aside, at):
            return True
        self._fs.delete(aside, False)
        return False

    def rename(self, old: str, new: str) -> bool:
        return self._fs.exists(self._at(old)) and self._fs.rename(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Lease:
    """At most one holder in a folder. A holder that died is succeeded once its time is over."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600):
        self.folder, self.seconds, self.owner = Folder(spark, path), seconds, uuid.uuid4().hex

    def take(self) -> bool:
        text = json.dumps({"owner": self.owner, "until": time.time() + self.seconds})
        if self.folder.create("_lease", text):
            return True
        held = self.folder.read("_lease")
        if held is None or json.loads(held)["until"] > time.time():
            return False
        gone = f".expired-{self.owner}"  # of several that see it expired, one can rename it
        taken = self.folder.rename("_lease", gone)
        if taken:
            self.folder.delete(gone)
        return taken and self.folder.create("_lease", text)

    def release(self) -> None:
        held = self.folder.read("_lease")
        if held is not None and json.loads(held)["owner"] == self.owner:
            self.folder.delete("_lease")
