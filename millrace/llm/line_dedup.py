"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is a candidate if it stands on at least ``min_sites`` different sites and in as many different texts, so copies of
one text spread nothing. Each line hash gets two HyperLogLog sketches, of its sites and of its texts, taken straight from
the lines and merged by partial aggregation, so a line held by a third of all rows is no hot key. Where both estimates are
clearly over the limit, or one is clearly under it, they decide; lines near it get exact distinct counts.

Edited copies of a text spread its lines too, but those are for near-dedup. So a candidate must stand in texts that differ by
what else they hold. The rest of a text, its lines that are no candidates, has two sketches of five words each: the least of
the words from the first place of each line's least word, and the greatest of those from its greatest word. Copies with
changed words share them mostly, other texts do not. A candidate is boilerplate if the distinct sketches of either kind are
``min_sites`` or more, and half of its distinct texts or more. Every copy of it goes from every document, whatever its share.

Defined results: a null text has no lines and stays null; a null site is a site of its own; lines are compared after
cutting spaces at both ends, and those under ``min_chars`` (blank ones) are never boilerplate; a document of boilerplate
only becomes an empty text; all texts of candidates only have one rest; repeated rows are treated alike; a very long text is cut in time proportional to its lines; an
empty table gives an empty table; further columns pass through unread, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, text_key

MIN_SITES, MIN_CHARS, LOG_K, SALT, WIDTH = 5, 1, 10, 32, 5


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.trim(x).alias("line"), F.char_length(x).alias("chars")))


def _salted(lines: DataFrame) -> DataFrame:
    """Lines to be joined, dealt to SALT tasks a line, so that one which most documents hold is not one task."""
    return lines.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _sketched(lines: DataFrame) -> DataFrame:
    """lines (of `line`) with `first` and `last`: WIDTH words from the first place of its least and of its greatest word.

    The words of a line are what single spaces separate, and the last WIDTH - 1 of them begin none, where there are more.
    """
    lines = lines.withColumn("w", F.split("line", " ", -1))
    lines = lines.withColumn("starts", F.slice("w", 1, F.greatest(F.size("w") - WIDTH + 1, F.lit(1))))
    ends = {n: F.array_join(F.slice("w", F.array_position("starts", best("starts")).cast("int"), WIDTH), " ") for n, best in (("first", F.array_min), ("last", F.array_max))}
    return lines.withColumns(ends).drop("w", "starts", "line")


def candidates(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, log_k: int = LOG_K) -> DataFrame:
    """(k1, k2) of each line on min_sites sites and in min_sites texts, or more."""
    where = F.when(F.col(site).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(site).cast("string"))).alias("site")
    lines = docs.select(where, F.xxhash64(text).alias("text"), F.explode(_lines(F.col(text))).alias("x")).filter(F.char_length("x.line") >= min_chars).select("site", "text", *text_key(F.col("x.line")))
    spread = lines.groupBy("k1", "k2").agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(log_k))).alias(n) for c, n in (("site", "sites"), ("text", "texts"))))
    slack = 4 * 1.04 / math.sqrt(2**log_k)
    least = F.least("sites", "texts")
    rated = saved(spread.filter(least >= min_sites * (1 - slack) - 1).select("k1", "k2", (least > min_sites * (1 + slack)).alias("far")), "rated")
    near = _salted(rated.filter("not far").select("k1", "k2"))
    met = lines.withColumn("s", F.pmod(F.xxhash64("text", "site"), F.lit(SALT)).cast("int")).join(near, ["k1", "k2", "s"], "left_semi")
    counted = [met.groupBy("k1", "k2", c).agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("k1", "k2") for c in ("site", "text")]
    return rated.filter("far").select("k1", "k2").unionByName(counted[0].join(counted[1], ["k1", "k2"], "left_semi"))


def marked(docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __a, __b, hit): positions of the boilerplate lines, in order, of each document with any."""
    own = [F.col(doc_id).alias("__id"), *(c.alias(f"__{n}") for c, n in zip(text_key(F.col(text)), ("a", "b"), strict=True))]
    lines = docs.select(*own, F.posexplode(_lines(F.col(text))).alias("pos", "x")).filter(F.char_length("x.line") >= min_chars)
    lines = _sketched(lines.select("__id", "__a", "__b", "pos", "x.line", *text_key(F.col("x.line")))).withColumn("s", F.pmod(F.xxhash64("__id", "__a", "pos"), F.lit(SALT)).cast("int"))
    met = lines.join(_salted(candidates(docs, site, text, min_sites, min_chars)).withColumn("met", F.lit(True)), ["k1", "k2", "s"], "left")
    rest = F.col("met").isNull()
    held = met.groupBy("__id", "__a", "__b").agg(F.collect_set(F.when(~rest, F.struct("pos", "k1", "k2"))).alias("hits"), F.min(F.when(rest, F.col("first"))).alias("first"), F.max(F.when(rest, F.col("last"))).alias("last"))
    sketches = F.array(*(F.struct(F.lit(n).alias("kind"), F.xxhash64(n).alias("value")) for n in ("first", "last")))
    held = saved(held.filter(F.size("hits") > 0).select("__id", "__a", "__b", "hits", sketches.alias("rest")), "hits")
    hits = held.select("__id", "__a", "__b", "rest", F.explode("hits").alias("x")).select("__id", "__a", "__b", "rest", "x.pos", "x.k1", "x.k2")
    seen = hits.select("k1", "k2", "__a", "__b", "rest").distinct().select("k1", "k2", F.explode("rest").alias("r")).groupBy("k1", "k2", "r.kind", "r.value").agg(F.count("*").alias("n"))
    spread = seen.groupBy("k1", "k2", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("rests")).groupBy("k1", "k2").agg(F.max("n").alias("n"), F.min("rests").alias("rests"))
    bad = spread.filter((F.col("rests") >= min_sites) & (2 * F.col("rests") >= F.col("n"))).select("k1", "k2")
    left = hits.withColumn("s", F.pmod(F.xxhash64("__id", "__a", "pos"), F.lit(SALT)).cast("int")).join(_salted(bad), ["k1", "k2", "s"], "left_semi")
    return left.groupBy("__id", "__a", "__b").agg(F.array_sort(F.collect_set("pos")).alias("hit"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines cut from the text, and the columns n_lines and n_removed (long)."""
    hits = marked(docs, doc_id, site, text, min_sites, min_chars).withColumnsRenamed({"__a": "__ha", "__b": "__hb", "hit": "__hit"})
    a, b = text_key(F.col(text))
    keyed = docs.withColumns({"__a": a, "__b": b}).alias("d")
    joined = keyed.join(hits, F.col(f"d.{doc_id}").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__ha")) & (F.col("__b") == F.col("__hb")), "left")
    parts, n = F.split(F.col(f"d.{text}"), "\n", -1), F.size("__hit")
    first = lambda i: F.when(i == 0, 0).otherwise(F.get("__hit", i - 1) + 1)
    runs = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(parts, first(i) + 1, F.when(i == n, F.size(parts)).otherwise(F.get("__hit", i)) - first(i)))
    cut = F.col("__hit").isNotNull()
    out = [F.when(cut, F.array_join(F.flatten(runs), "\n")).otherwise(F.col(f"d.{text}")).alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*out, F.coalesce(F.size(parts).cast("long"), F.lit(0)).alias("n_lines"), F.when(cut, n).otherwise(0).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
candidates AS (
  SELECT trim(raw, ' ') AS line FROM lines WHERE length(trim(raw, ' ')) >= {MIN_CHARS}
  GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES} AND count(DISTINCT text) >= {MIN_SITES}),
words AS (
  SELECT text, line, string_split(trim(raw, ' '), ' ') AS w, w[:greatest(len(w) - {WIDTH - 1}, 1)] AS starts
  FROM lines LEFT JOIN candidates ON line = trim(raw, ' ') WHERE length(trim(raw, ' ')) >= {MIN_CHARS}),
places AS (SELECT text, line, w, list_position(starts, list_min(starts)) AS p, list_position(starts, list_max(starts)) AS q FROM words),
rests AS (
  SELECT text, min(array_to_string(w[p:p + {WIDTH - 1}], ' ')) FILTER (line IS NULL) AS first,
         max(array_to_string(w[q:q + {WIDTH - 1}], ' ')) FILTER (line IS NULL) AS last
  FROM places GROUP BY text),
spread AS (
  SELECT line, count(*) AS n, least(count(DISTINCT first), count(DISTINCT last)) + max((first IS NULL)::INT) AS rests
  FROM (SELECT DISTINCT line, text FROM words WHERE line IS NOT NULL) JOIN rests USING (text) GROUP BY line),
bad AS (SELECT line FROM spread WHERE rests >= {MIN_SITES} AND 2 * rests >= n),
marked AS (SELECT l.*, b.line IS NOT NULL AS hit FROM lines l LEFT JOIN bad b ON b.line = trim(l.raw, ' ')),
docs AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (hit) AS h, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT hit) AS kept
  FROM marked GROUP BY doc_id)
SELECT o.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(h, 0)::BIGINT AS n_removed,
       md5(CASE WHEN h > 0 THEN coalesce(kept, '') ELSE o.text END) AS text_md5
FROM documents o LEFT JOIN docs d USING (doc_id)
"""
