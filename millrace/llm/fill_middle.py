"""Fill-in-the-middle: texts cut in two places and put in another order, by bit-parallel work on big integers.

A text's UTF-8 bytes become one integer for each class of bytes, by ``bytes.translate``, with bit i for byte i. A code point
ends after byte i where byte i + 1 begins one, so one shift of the mask of first bytes marks all ends at once, and its
``bit_count`` is the number of code points. Marks ``<P>``, ``<S>``, ``<M>`` in the text itself show as three masks, two of them shifted,
that meet in a bit. The byte at which a cut falls is the rank of a set bit, selected by halving the integer: the half that
holds the rank is known from the other's ``bit_count``, so the work is the length of the text, half of it, a quarter and so on.

The cuts and the form depend on the id and the seed only, so reruns, retries and other partitionings agree.

Defined results: a null text is the empty text, which stays plain; a null id counts as the id without digits; rows that
repeat an id draw alike; a text that holds a mark stays plain, so the order can always be undone; a very long text takes time
and memory in proportion to its length; an empty table gives an empty table; further columns pass through, but for those
named n, form, prefix_chars, middle_chars and output, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, read

SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
NEW = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def _class(members: bytes) -> bytes:
    """A table for bytes.translate: digit 1 for the members, else 0."""
    return bytes(b"1"[0] if b in members else b"0"[0] for b in range(256))


FIRST = _class(bytes(b for b in range(256) if not 0x80 <= b < 0xC0))
OPENING, LETTER, CLOSING = _class(b"<"), _class(b"PSM"), _class(b">")


def mask(text: bytes, table: bytes) -> int:
    """Bit i is set where byte i is in the class."""
    return int(text.translate(table)[::-1] or b"0", 2)


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit with `rank` set bits below it."""
    place = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, place = bits >> half, width - half, rank - below, place + half
    return place


def marked(text: bytes) -> bool:
    """Whether <P>, <S> or <M> stands in the text."""
    opening = mask(text, OPENING)
    return bool(opening and opening & (mask(text, LETTER) >> 1) & (mask(text, CLOSING) >> 2))


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def cut(text: bytes, doc_id: int | None, seed: int = SEED) -> Cut:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))
    size = len(text)
    ends = mask(text, FIRST) >> 1 | 1 << size - 1 if size else 0
    n = ends.bit_count()
    if not text or h3 % 100 >= PLAIN_FROM or marked(text):
        return Cut(n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (select(ends, k - 1, size) + 1 if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SPM_BELOW:
        return Cut(n, "spm", a, b - a, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle)))
    return Cut(n, "psm", a, b - a, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle)))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs with n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    new = {f.name for f in NEW}
    own = docs.select(*(c for c in docs.columns if c not in new), F.col(doc_id).cast("string").alias("__id"), F.coalesce(text, F.lit("")).alias("__text"))
    keep = own.columns[:-2]
    schema = T.StructType([*own.schema.fields[:-2], *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id").to_pylist()
            for start, texts in chunks(batch, "__text"):
                cuts = [cut(t, i, seed) for t, i in zip(texts, ids[start : start + len(texts)], strict=True)]
                part = batch.slice(start, len(texts))
                made = [pa.array([c.n for c in cuts], pa.int64()), pa.array([c.form for c in cuts], pa.string()), pa.array([c.prefix_chars for c in cuts], pa.int64()), pa.array([c.middle_chars for c in cuts], pa.int64()), pa.array([c.output for c in cuts], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text before it was cut. Its parts hold no mark and none can arise where they meet, so the marks split them."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(x.cast("binary"), 256).alias(n) for x, n in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS g FROM texts),
formed AS (
  SELECT doc_id, t, n, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain'
              WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
