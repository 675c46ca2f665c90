"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by cuts in their order (id, then digest), sorted within a shard, and written as one gzip member
each; a file rolls once its compressed size passes ``roll_bytes``. The cuts are taken from a bounded sample chosen by the
ids' own hashes, so equal input gives equal cuts; all rows between two neighbours of the sample are counted and weighed,
and neighbours make a shard up to ``shard_rows`` rows or ``shard_bytes`` bytes. So pages of many megabytes side by side
are several shards, and so are different payloads under one id. HTTP and WARC headers, record ids and digests are regenerated from the data, and
the date is a parameter, so equal input gives equal files, byte for byte.

Commit: a task attempt writes to names of its own under ``_tmp`` and returns manifest rows. The manifest is committed as a
table, which holds the rows of one attempt for each task; then the files that it names move to their final names. A lost
executor leaves only files that no manifest names, and these are removed. Moving is idempotent.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest id is a response, the others
revisit it. Defined results: a null html is an empty payload; a null url has no target header; null ids come last in the
order, and a group with null ids only is revisited with an unknown reference; of rows that repeat an id and a payload one
is the response; an empty table gives no files; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, read, saved, shared_dir

ROLL_BYTES, MIN_REVISIT, SHARD_ROWS, SHARD_BYTES, MAX_SAMPLE, NULL_SHARDS = 64 << 20, 100, 5_000, 32 << 20, 200_000, 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("name", pa.string()), ("temp", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("file", pa.string())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest + '|revisit' * revisit)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {re.sub('[\\x00-\\x20]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []
    head += [f"Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"] + ([f"Refers-To-Page-Id: {first}"] if first is not None else [])
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Roller:
    """The files of one task attempt."""

    def __init__(self, uri: str, roll_bytes: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(f"{self.path}/_tmp", recursive=True)
        self.roll_bytes, self.shard, self.seq, self.out, self.done = roll_bytes, None, 0, None, []

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.name, self.temp, self.records, self.size, self.sha.hexdigest()))
            self.out = None

    def put(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if not self.out:
            self.name = f"part-{shard:06d}-{self.seq:04d}.warc.gz"
            self.temp = f"{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.sha = self.fs.open_output_stream(f"{self.path}/_tmp/{self.temp}", compression=None), 0, 0, hashlib.sha256()
            self.seq += 1
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.roll_bytes:
            self.close()

    def rows(self) -> pa.RecordBatch:
        out, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, MANIFEST, strict=True)], schema=MANIFEST)


def place_of(cuts: list[tuple[int, str]], ids: np.ndarray, digests: Sequence[str]) -> np.ndarray:
    """How many cuts are at or before each (id, digest)."""
    keys = np.array([c[0] for c in cuts], np.int64)
    low, high = np.searchsorted(keys, ids, side="left"), np.searchsorted(keys, ids, side="right")
    for i in np.flatnonzero(low < high).tolist():  # ids that are a cut: the digest decides
        high[i] = bisect_right(cuts, (int(ids[i]), digests[i]))
    return high


def placed(cuts: list[tuple[int, str]]) -> Column:
    @F.pandas_udf("int")
    def place(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(place_of(cuts, ids.fillna(0).astype("int64").to_numpy(), digests.tolist()).astype("int32"))

    return place("page_id", "digest")


def cuts_of(rows: DataFrame, shard_rows: int, shard_bytes: int) -> list[tuple[int, str]]:
    """The first (id, digest) of each shard but the first. rows: (page_id, digest, bytes)."""
    some = rows.filter(F.col("page_id").isNotNull())
    n, size = some.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(-(-n // shard_rows), -(-size // shard_bytes))
    if shards <= 1:
        return []
    marks = sorted({(r["page_id"], r["digest"]) for r in chosen(some.select("page_id", "digest"), min(20 * shards, MAX_SAMPLE), "page_id", "digest", total=n).collect()})
    held = {r["bin"]: (r["n"], r["size"]) for r in some.groupBy(placed(marks).alias("bin")).agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).collect()}  # a row for each mark
    cuts, count, weight = [], 0, 0
    for i in range(len(marks) + 1):
        more, heavier = held.get(i, (0, 0))
        if count and (count + more > shard_rows or weight + heavier > shard_bytes):
            cuts.append(marks[i - 1])
            count = weight = 0
        count, weight = count + more, weight + heavier
    return cuts


def write_archives(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archives under out; returns the manifest."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", F.sha2("payload", 256).alias("digest"), "url", "payload")
    narrow = saved(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    cuts = cuts_of(narrow, shard_rows, shard_bytes)
    small = narrow.filter(F.col("bytes") >= min_revisit).select("page_id", "digest")
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refs = small.join(firsts, "digest").groupBy("page_id", "digest").agg(F.first("first").alias("first"))  # ids only; AQE splits a hot digest
    both = rows.withColumns({"first": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(refs.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first", F.lit(0).alias("kind")))
    dealt = both.withColumn("shard", F.when(F.col("page_id").isNull(), len(cuts) + 1 + F.pmod(F.xxhash64("digest"), F.lit(NULL_SHARDS)).cast("int")).otherwise(placed(cuts))).repartitionById(len(cuts) + 1 + NULL_SHARDS, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known, seen = None, (None, None), None
        first = None
        for batch in batches:
            roller = roller or Roller(out, roll_bytes)
            for shard, pid, digest, link, data, ref, kind in zip(*(batch.column(c) for c in ("shard", "page_id", "digest", "url", "payload", "first", "kind")), strict=True):
                pid, digest = pid.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    known, first = (pid, digest), ref.as_py()
                    continue
                twin = known == (pid, digest)
                revisit = twin and (first != pid or seen == (pid, digest))
                seen = (pid, digest) if twin else seen
                roller.put(shard.as_py(), record(pid, link.as_py(), data.as_py(), digest, first, revisit))
            if roller.done:
                yield roller.rows()
        if roller:
            roller.close()
            yield roller.rows()

    wrote = saved(dealt.mapInArrow(write, "name string, temp string, records long, bytes long, sha256 string"), "manifest")

    def promote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out)
        for batch in batches:
            for name, temp in zip(batch.column("name").to_pylist(), batch.column("temp").to_pylist(), strict=True):
                if fs.get_file_info(f"{path}/_tmp/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/_tmp/{temp}", f"{path}/{name}")
            yield batch

    manifest = saved(wrote.mapInArrow(promote, wrote.schema).drop("temp"), "manifest")
    fs, path = filesystem(out)
    if fs.get_file_info(f"{path}/_tmp").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/_tmp")
    return manifest


def members(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    unpack, got, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        got.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(got)
            unpack, got = zlib.decompressobj(31), []
        data = data or stream.read(chunk)
    if got:
        raise ValueError("the archive ends within a record")


def parsed(data: bytes, file: str, with_payload: bool = False) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{file}: no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{file}: wrong block digest in {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{file}: wrong payload digest in {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("Page-Id"), size, digest, kind, number("Refers-To-Page-Id"), fields.get("WARC-Target-URI"), payload if with_payload else None, file


def read_archives(manifest: DataFrame, out: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives that the manifest names; digests are verified."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out)
        for name in (n for b in batches for n in b.column("name").to_pylist()):
            with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                rows, held = [], 0
                for data in members(f):
                    rows.append(parsed(data, name, with_payload))
                    held += len(data)
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), PAGE, strict=True)], schema=PAGE)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), PAGE, strict=True)], schema=PAGE)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string"
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(load, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    manifest = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), out)
    return read_archives(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND first <> page_id THEN first END AS refers_to
FROM f
"""
