"""URL filter: a Bloom filter cascade over the complete universe of probe keys, in DataFrame functions only.

Each url is probed with every (host suffix, path prefix) pair that has the shape (number of labels, path length) of some
rule. Levels alternate: level 1 encodes the listed keys of the universe, level 2 the universe's other keys that level 1
takes for listed, level 3 the listed keys that level 2 takes for false positives, and so on until none is left. As the
cascade was built over the whole universe, its answer is exact for every probe, and no row is joined with a list.
One cascade holds all rules, a second one those that allow.

Level 1 is sized by the list and the universe: each doubling of others / listed halves the share of false positives that it
lets pass, so level 2 is about as large as the list, however large the universe, and a listed key costs about
2 log2(others / listed) bits in all. The filters are arrays of 64-bit words, read as scalar subqueries. Where one would need
over ``MAX_WORDS`` words, keys are dealt to parts by a hash and each part has a cascade of its own; ``MAX_PARTS`` parts (some
17 million listed keys that the corpus holds, at 60 bits) bound what tasks hold.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a url that fits none is
allowed, since the cascade holds listed keys only. The longest rule wins (host, then path). Repeated rows are judged
alike; an empty table gives an empty table; further columns pass through, but for host, path, rule and verdict, which are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

BITS, MAX_WORDS, MAX_LEVELS, MAX_PARTS = 4, 1 << 20, 64, 16
#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _seed(level: int, turn: int) -> int:
    return level * 256 + turn


def _word(key: Column, words: int, level: int, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(_seed(level, turn)), key), F.lit(words)).cast("int")


def _mask(key: Column, level: int, turn: int) -> Column:
    """BITS bits of one 64-bit word, from six bits each of a second hash."""
    h, out = F.xxhash64(F.lit(-1 - _seed(level, turn)), key), F.lit(0).cast("long")
    for j in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


@dataclass(frozen=True)
class Level:
    """A Bloom filter: an array of n words, in which a key sets BITS bits of a word in each of `turns` turns."""

    words: Column
    n: int
    turns: int

    def test(self, key: Column, level: int) -> Column:
        out = F.lit(True)
        for t in range(self.turns):
            mask = _mask(key, level, t)
            out = out & (F.get(self.words, _word(key, self.n, level, t)).bitwiseAND(mask) == mask)
        return out


def size_of(keys: int, others: int, first: bool) -> tuple[int, int]:
    """(words, turns) of a level: the first one lets about as many of the others pass as there are keys, later ones a few in a hundred."""
    turns = max(1, math.ceil(math.log2(max(2.0, others / max(1, keys))) / 3)) if first else 1
    return max(1, -(-keys * (6 * turns if turns > 1 else 10) // 64)), turns


def cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels of a cascade. listed and others: disjoint sets, distinct, in a column `key`."""
    spark, levels, enc, alt = listed.sparkSession, [], listed, others
    rest = others.count()
    while len(levels) < MAX_LEVELS and (count := enc.count()):
        level = len(levels)
        n, turns = size_of(count, rest, level == 0)
        key = F.col("key")
        spots = enc.select(F.explode(F.array(*(F.struct(_word(key, n, level, t).alias("w"), _mask(key, level, t).alias("m")) for t in range(turns)))).alias("x"))
        bits = spots.groupBy("x.w").agg(F.bit_or("x.m").alias("b"))
        got = spark.range(n).select(F.col("id").cast("int").alias("w")).join(bits, "w", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("words"))
        levels.append(Level(saved(got, "level").scalar(), n, turns))  # a scalar subquery: the array stays in the JVM
        enc, alt = saved(alt.filter(levels[-1].test(key, level)), "cascade"), enc
    if len(levels) == MAX_LEVELS:
        raise ValueError("the cascade does not end: two keys share all hashes")
    return levels


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-(1 << 40)), key), F.lit(parts))


def cascades(listed: DataFrame, others: DataFrame, max_words: int = MAX_WORDS) -> list[list[Level]]:
    """One cascade, or one for each part of the keys."""
    parts = -(-size_of(listed.count(), others.count(), True)[0] // max_words)
    if parts > MAX_PARTS:
        raise ValueError(f"the list needs {parts} parts of {max_words} words, over {MAX_PARTS}")
    if parts <= 1:
        return [cascade(listed, others)]
    mine = lambda df, i: df.filter(_part(F.col("key"), parts) == i)
    return [cascade(mine(listed, i), mine(others, i)) for i in range(parts)]


def contains(key: Column, parts: list[list[Level]]) -> Column:
    """The first level that says no decides: an odd one (counted from 1) means not listed."""
    answers = []
    for levels in parts:
        out = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            out = F.when(levels[i].test(key, i), out).otherwise(F.lit(i % 2 == 1))
        answers.append(out)
    whole = answers[-1]
    for i in reversed(range(len(answers) - 1)):
        whole = F.when(_part(key, len(answers)) == i, answers[i]).otherwise(whole)
    return whole


def _cuts(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """(host suffix, path prefix) for each shape, longest first; null where the url is too short."""
    labels = F.split(host, "\\.", -1)
    return [F.when((F.size(labels) >= n) & (F.char_length(path) >= p) & (host != ""), F.struct(F.array_join(F.slice(labels, -n, n), ".").alias("host"), F.substring(path, 1, p).alias("path"))) for n, p in shapes]


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", max_words: int = MAX_WORDS) -> DataFrame:
    """urls with host, path, rule and verdict. rules: (verdict, host, path), at most a few hundred shapes."""
    spark = urls.sparkSession
    shapes = [(r.n, r.p) for r in rules.select(F.size(F.split("host", "\\.", -1)).alias("n"), F.char_length("path").alias("p"), F.char_length("host").alias("h")).groupBy("n", "p").agg(F.max("h").alias("h")).orderBy(F.desc("n"), F.desc("p")).collect()]
    parts = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    probed = parts.select(F.explode(F.array_compact(F.array(*_cuts(F.col("host"), F.col("path"), shapes)))).alias("x")).select(key_of(F.col("x.host"), F.col("x.path")).alias("key"))
    universe = probed.groupBy("key").agg(F.lit(1).alias("one"))
    keyed = rules.groupBy(key_of(F.col("host"), F.col("path")).alias("key")).agg(F.max(F.col("verdict") == "allow").alias("allow"))
    split = saved(universe.join(keyed, "key", "left").select("key", F.col("allow")), "universe")
    listed, others = split.filter(F.col("allow").isNotNull()).select("key"), split.filter(F.col("allow").isNull()).select("key")
    allowed, blocked = split.filter("allow").select("key"), split.filter("not allow").select("key")
    member, allow = cascades(listed, others, max_words), cascades(allowed, blocked.unionByName(others), max_words)
    cuts = _cuts(F.col("host"), F.col("path"), shapes)
    hit = F.coalesce(*(F.when(x.isNotNull() & contains(key_of(x["host"], x["path"]), member), x) for x in cuts))
    out = parts.withColumn("__hit", hit)
    ok = contains(key_of(F.col("__hit.host"), F.col("__hit.path")), allow)
    return out.withColumns({"rule": F.concat(F.col("__hit.host"), F.col("__hit.path")), "verdict": F.when(F.col("__hit").isNull() | ok, "allow").otherwise("block")}).drop("__hit")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = rf"coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))
ORACLE = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{v}'" for v, h, p in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM p
"""
