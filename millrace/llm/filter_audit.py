"""Filter interaction audit: every order of five filters replayed over the documents' flags.

A document fails any of five filters: A few words, B few distinct words, C many capitals, D symbols, E a copy of a text with
a smaller id. What a filter removes depends on those before it, so all 120 orders are replayed: the documents' flags are
crossed with the broadcast orders, each pair is exploded to its five steps, the first failure says where the document goes,
and conditional sums by part, order and step are combined before the shuffle. Documents of one part with the same flags and
labels fare alike in every order, so they are summed to one weighted row before they meet the orders: a part brings at most
128 rows to the cross, whatever the corpus holds. Texts are read once and never shuffled; copies are found by two 64-bit hashes.

Defined results: a null text is the empty text (it fails A alone, and E where another such text has a smaller id); a null
language and the empty one are one part, the empty string; a document with a null id is a copy of nothing and has no label,
and no document is a copy of it; rows that repeat id and text are documents of their own, none of them a copy of the other;
several labels of an id count as the best quality and the worst toxicity among them; null labels are neither; a very long
text costs time and memory in proportion to its length; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, read, saved, text_key

FILTERS, SALT = "ABCDE", 16
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def failures(text: Column) -> list[Column]:
    """Whether a text, not null, fails A, B, C and D."""
    words = F.array_remove(F.split(text, WORD_BREAK, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    few, same = n < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long")
    return [few, same, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic), a row for each document; fails has bit i for filter i."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failures(F.col("t")))]
    facts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t")).select("doc_id", "part", *text_key(F.col("t")), sum(bits[1:], bits[0]).alias("fails"))
    facts = saved(facts, "flags")
    many = facts.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "first")
    many = many.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a text that a third of all rows hold meets SALT tasks
    facts = facts.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(many, ["k1", "k2", "s"], "left")
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    facts = facts.withColumn("z", F.when(F.col("doc_id").isNull(), F.pmod("k1", F.lit(1024))).otherwise(0))  # null ids meet nothing, in many tasks
    facts = facts.join(known.withColumn("z", F.lit(0).cast("long")), ["doc_id", "z"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return facts.select("part", (F.col("fails") + copy).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replayed(flags: DataFrame) -> DataFrame:
    """The counts of each part, order and step. flags: part, fails, good, toxic."""
    spark = flags.sparkSession
    alike = flags.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    orders = spark.createDataFrame([("".join(FILTERS[i] for i in p), list(p)) for p in permutations(range(len(FILTERS)))], "filter_order string, filters array<int>")
    met = alike.crossJoin(F.broadcast(orders))  # 120 rows, always
    fails = F.transform("filters", lambda i: F.call_function("shiftright", F.col("fails"), i).bitwiseAND(1))
    met = met.withColumn("at", F.array_position(fails, 1))
    met = met.withColumn("first", F.when(F.col("at") == 0, len(FILTERS) + 1).otherwise(F.col("at"))).select("*", F.posexplode("filters").alias("pos", "filter"))
    met = met.withColumns({"step": F.col("pos") + 1, "here": F.call_function("shiftright", F.col("fails"), F.col("filter")).bitwiseAND(1) == 1, "alone": F.bit_count("fails") == 1})
    gone = F.col("first") == F.col("step")
    counts = {"kept": F.col("first") > F.col("step"), "removed": gone, "redundant": F.col("here") & (F.col("first") < F.col("step")), "unique_fails": F.col("here") & F.col("alone"), "good_lost": gone & F.col("good"), "toxic_lost": gone & F.col("toxic")}
    out = met.groupBy("part", "filter_order", "step", "filter").agg(*(F.sum(F.when(x, F.col("n")).otherwise(0)).alias(c) for c, x in counts.items()))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")  # 120 rows a filter


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    return replayed(flagged(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, [w FOR w IN string_split_regex(t, '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM texts),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM worded LEFT JOIN known USING (doc_id)),
lettered AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM judged),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS filter, substr(filter_order, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, filter,
         count(*) FILTER (NOT regexp_matches(failed, '[' || earlier || filter || ']'))::BIGINT AS kept,
         count(*) FILTER (gone)::BIGINT AS removed,
         count(*) FILTER (contains(failed, filter) AND NOT gone)::BIGINT AS redundant,
         count(*) FILTER (failed = filter)::BIGINT AS unique_fails,
         count(*) FILTER (gone AND good)::BIGINT AS good_lost,
         count(*) FILTER (gone AND toxic)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(failed, filter) AND (earlier = '' OR NOT regexp_matches(failed, '[' || earlier || '0]')) AS gone FROM lettered, steps)
  GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""
