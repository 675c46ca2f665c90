"""The pipeline on the smallest tables against a brute-force version of each stage."""

import math
import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from millrace.llm import cube_mix, kneser_ney
from millrace.llm.common import read, saved

from .test_other_operators import targets
from .test_text_operators import boilerplate, brute_similarity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs.collect())
        docs = saved(stage(spark, docs, SF), name)
    return [*out, docs.collect()]


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_columns_and_whole_run(spark, stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[-1]))


def test_quality(spark, stages):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows, others = kneser_ney.figures(docs, labels, max_grams=0)  # by joins
    held = {r[0] for r in others.collect()}
    figures = [(r["id"], r["lang"], 10 ** (-r["log10"] / r["tokens"]), r["sharpest"]) for r in rows.collect() if r["tokens"]]
    limits = {}
    for lang in {f[1] for f in figures}:
        mine = [f for f in figures if f[1] == lang and f[0] in held]
        pick = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
        if mine:
            limits[lang] = pick([f[2] for f in mine], kneser_ney.Q) * kneser_ney.SLACK, pick([f[3] for f in mine], kneser_ney.Q_WORD) - kneser_ney.SLACK_WORD
    gone = {i for i, lang, p, s in figures if lang in limits and (p > limits[lang][0] or s < limits[lang][1])}
    assert set(by_id(stages[1])) == set(by_id(stages[0])) - gone and gone


def test_quality_of_a_large_model_joins_no_words(spark, stages, monkeypatch):
    """Of models that are too large together, each language's is sent; none is joined with all documents' words, which took the disk at 6 GB."""
    sizes, grouped = {}, kneser_ney.grouped
    monkeypatch.setattr(kneser_ney, "grouped", lambda x, most: sizes.update(x) or grouped(x, max(x.values())))
    monkeypatch.setattr(kneser_ney, "score_joined", None)
    kept = corpus_pipeline.quality(spark, read(spark, SF, "documents"), SF).collect()
    assert len(grouped(sizes, max(sizes.values()))[0]) > 1 and Counter(map(tuple, kept)) == Counter(map(tuple, stages[1]))


def test_lines(stages):
    want = {}
    bad, _ = boilerplate((r["text"], r["source"]) for r in stages[1])
    for i, t in by_id(stages[1]).items():
        want[i] = "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
    assert by_id(stages[2]) == want and bad


def test_near_duplicates(stages):
    docs = by_id(stages[2])
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = defaultdict(list)
    for d, t in docs.items():
        w = t.lower().split()
        for g in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ():
            some[g].append(d)
    for pair in {(a, b) for ds in some.values() for a in ds for b in ds if a < b}:
        if brute_similarity(docs[pair[0]], docs[pair[1]]) >= 0.8:
            a, b = sorted(map(find, pair))
            parent[b] = a
    assert set(by_id(stages[3])) == {find(d) for d in docs}


def test_benchmark(spark, stages):
    strip = re.compile(r"^[\W_]+|[\W_]+$")
    tokens = lambda t: [w for w in (strip.sub("", x).lower() for x in t.split()) if w]
    grams, total = defaultdict(set), {}
    for r in read(spark, SF, "benchmark").collect():
        w = tokens(r["text"])
        total[r["item_id"]] = max(1, len(w) - 7)
        for i in range(total[r["item_id"]]):
            grams[tuple(w[i : i + 8])].add((r["item_id"], i))
    gone = set()
    for d, t in by_id(stages[3]).items():
        w, hit = tokens(t), defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in grams.get(tuple(w[i : i + 8]), ()):
                hit[item].add(at)
        if any(len(h) >= 0.3 * total[item] for item, h in hit.items()):
            gone.add(d)
    assert set(by_id(stages[4])) == set(by_id(stages[3])) - gone and gone


def test_mix(stages):
    size, taken, largest = Counter(), Counter(), Counter()
    for r in stages[4]:
        n = len(r["text"].encode().split())
        size[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    docs = by_id(stages[4])
    for r in stages[5]:
        assert docs[r["doc_id"]] == r["text"] and 1 <= r["copies"] <= cube_mix.MAX_REPEAT
        taken[r["source"]] += r["copies"] * len(r["text"].encode().split())
    want = targets(dict(size))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)


def test_hard_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, further columns; then empty tables."""
    from pyspark.sql import functions as F

    some = read(spark, SF, "documents").limit(40)
    null = some.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema))
    long = some.limit(1).withColumns({"doc_id": F.lit(999_999).cast(some.schema["doc_id"].dataType), "text": F.repeat(F.concat("text", F.lit("\n")), 2000)})
    docs = some.unionByName(some.limit(5)).unionByName(null).unionByName(long).unionByName(some.limit(2).withColumn("text", F.lit(""))).withColumns({"copies": F.lit("x"), "size": F.lit(1), "k1": F.lit(2), "label": F.lit("y")})
    for name in ("documents", "labels", "benchmark"):
        (docs if name == "documents" else read(spark, SF, name)).write.parquet(f"{tmp_path}/a/{name}.parquet")
        (docs if name == "documents" else read(spark, SF, name)).limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert set(out.columns) == set(docs.columns) and out.count() > 0
    assert out.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
