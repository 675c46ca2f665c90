"""Mixing, WARC, the language model, URL filter and top-k search on small tables, with hard rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import cube_mix, hmm_lm, url_filter, voronoi_knn, warc
from millrace.llm.common import shared_dir


def targets(sizes):
    """By stepwise resharing, as the contract has it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [5000, 16])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["hot"] * 6 + ["a", "b", "é", "z", None]), "x") for i in range(900)]
    rows += [(2000, None, "a", "x"), (2001, "", "b", "x"), (2002, "v\u00a0w\u2003x y\x1cz", "b", "x"), (2003, "w " * 5000, "one", "x"), (2005, "w " * 700, "hot", "x"), (None, "a b c", "a", "x"), (1, "a b", "small", "x"), (1, "a b", "small", "x"), (2004, None, "void", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = cube_mix.mix(docs, block=block).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    want = targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (largest[s] + 1 if block == 16 or sum(x[2] == s for x in rows) < 30 else 10)
        of = [r for r in got if r["source"] == s]
        assert not sizes[s] or abs(sum(r["copies"] for r in of) - len(of) * want[s] / sizes[s]) < 1 + 1e-6
    again = cube_mix.mix(docs.repartition(7), block=block).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert cube_mix.mix(docs.limit(0)).count() == 0
    out = cube_mix.mixed(docs, block=block)
    assert set(out.columns) == {"doc_id", "text", "source", "copies", "size"}
    assert out.filter("copies < 1 or copies > 3").count() == 0


def test_flight_keeps_both_totals():
    g = np.random.default_rng(4)
    p, x = g.random(200), g.integers(1, 500, 200).astype(float)
    q = cube_mix.flight(p, x, "s")
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ x - p @ x) < 1e-4
    mean = np.mean([cube_mix.flight(p, x, f"s{i}") for i in range(300)], axis=0)
    assert np.abs(mean - p).max() < 0.15  # inclusion probabilities hold
    for i in range(50):
        q = cube_mix.flight(p, x, f"s{i}", land=True)
        assert set(q) <= {0.0, 1.0} and abs(q.sum() - p.sum()) < 1 and abs(q @ x - p @ x) < 5
    assert cube_mix.flight(np.full(3, 0.4), np.ones(3), "s", land=True).sum() in (1, 2)
    assert cube_mix.landed([0.5, 0.5], [10, 1]) in ([1.0, 0.0], [0.0, 1.0])


def test_repeated_rows_are_split_into_blocks(spark):
    rows = [(None, "w w", "a")] * 400 + [(i, "w " * (1 + i % 9), "a") for i in range(200)] + [(1, "w w w", "b")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    got = cube_mix.mix(docs, block=20).collect()
    for r in got:
        sizes[r["source"]] += r["size"]
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] for r in mine) - len(mine) * mine[0]["target"] / sizes[s]) < 1 + 1e-6
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 4
    assert Counter(map(tuple, got)) == Counter(map(tuple, cube_mix.mix(docs.repartition(5), block=20).collect()))


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    rng = random.Random(1)
    big = "é" * 90
    rows = [(i, f"http://x.org/{i}", f"<p>{rng.random()}</p>" * 20, "d") for i in range(60)]
    rows += [(100, "http://a", big, "d"), (99, "http://b c\r\nX: y", big, "d"), (101, None, big, "d"), (102, "u", "short", "d"), (103, "u", "short", "d"), (104, "u", None, "d"), (105, "u", "", "d"), (None, "u", big, "d"), (106, "u", "a\r\n\r\nWARC/1.1\r\n" * 20, "d"), (107, "u", "z" * 3_000_000, "d"), (99, "http://b c\r\nX: y", big, "d")]
    rows += [(500, f"http://same/{i}", f"<p>{i}</p>" * 40, "d") for i in range(70)]  # one id, many payloads

    pages = spark.createDataFrame(rows, PAGES)

    def write(df, name):
        out = f"{shared_dir(spark)}/{name}"
        m = warc.write_archives(df, out, roll_bytes=20_000, shard_rows=20, shard_bytes=1_000_000)
        return out, m

    out, manifest = write(pages, "w1")
    got = warc.read_archives(manifest, out, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", []).append(math.inf if i is None else i)
    seen = Counter()
    for r in got:
        h = next(h or "" for i, _, h, _ in rows if i == r["page_id"] and hashlib.sha256((h or "").encode()).hexdigest() == r["payload_digest"])
        data = h.encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        seen[h, r["record_type"]] += 1
        if r["record_type"] == "response":
            assert r["payload"] == data
        if len(data) < 100:
            assert r["record_type"] == "response" and r["refers_to"] is None
        elif r["record_type"] == "revisit":
            assert r["refers_to"] == min(first[h])
    assert seen[big, "response"] == 1 and seen[big, "revisit"] == 4
    _, other = write(pages.repartition(5), "w2")
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, other.collect()))  # byte for byte
    assert manifest.count() > 8 and max(r["records"] for r in manifest.collect()) <= 21
    assert warc.place_of([(3, "b"), (3, "d"), (7, "a")], np.array([3, 3, 3, 2, 7, 9]), ["a", "b", "e", "z", "b", ""]).tolist() == [0, 1, 2, 0, 3, 3]
    empty = warc.write_archives(pages.limit(0), f"{shared_dir(spark)}/w3")
    assert empty.count() == 0 and warc.read_archives(empty, f"{shared_dir(spark)}/w3").count() == 0


def test_language_model_base_scores_and_held_out_gain(spark):
    rng = random.Random(8)
    banks = [[f"{c}{i}" for i in range(40)] for c in "abcd"]
    rows = [(i, " ".join(rng.choice(banks[i % 4]) for _ in range(rng.randrange(20, 80))).upper()) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words"), (None, "a1 a2"), (1003, " ".join(rng.choice(banks[0]) for _ in range(20_000))), (5, "a1\x0ba2\u00a0b1")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, symbols int")
    got = hmm_lm.scores(docs, head=100, sample_docs=100).collect()
    train, ends = Counter(), 0
    tokens = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, t in rows:
        if not out(i):
            train.update(tokens(t))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    lp = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter((i, out(i), len(tokens(t)) + 1, sum(train[w] > 0 for w in tokens(t)) + 1, n, round(sum(lp(train[w]) for w in tokens(t)) + lp(ends), 4)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.95
    assert hmm_lm.scores(docs.limit(0)).count() == 0
    none = hmm_lm.scores(docs.filter(F.col("doc_id").isin([i for i, _ in rows if i is not None and out(i)][:3]))).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_forward_is_exact_and_baum_welch_climbs():
    g = np.random.default_rng(2)
    k, v = 3, 7
    m = hmm_lm.Model(g.dirichlet(np.ones(k)), g.dirichlet(np.ones(k), k), g.dirichlet(np.ones(v), k).T)
    docs = [g.integers(0, v, n).astype(np.int32) for n in (1, 2, 5, 3)]
    for some, symbols, first in hmm_lm.lanes(docs, 8):
        got = hmm_lm.forward(m, symbols, first, False)[0]
        for i, x in zip(some, got, strict=True):
            total = 0.0
            for path in np.ndindex(*[k] * len(docs[i])):
                p = m.start[path[0]]
                for t, s in enumerate(path):
                    p *= m.emit[docs[i][t], s] * (m.move[path[t - 1], s] if t else 1)
                total += p
            assert math.isclose(10**x, total, rel_tol=1e-9)
            start, move, emit = hmm_lm.expected(m, *next(iter([(s, f) for _, s, f in hmm_lm.lanes([docs[i]])])))
            assert math.isclose(emit.sum(), len(docs[i])) and math.isclose(move.sum(), len(docs[i]) - 1, abs_tol=1e-9) and math.isclose(start.sum(), 1)


def test_baum_welch_turns_over_partitions_climb(spark, monkeypatch):
    g = np.random.default_rng(6)
    k, v = 3, 9
    m = hmm_lm.Model(g.dirichlet(np.ones(k)), g.dirichlet(np.ones(k), k), g.dirichlet(np.ones(v), k).T)
    docs = [((np.arange(n) + g.integers(0, 3)) % 3 * 3 + g.integers(0, 3, n)).astype(np.int32) for n in g.integers(5, 60, 80)]
    corpus = spark.createDataFrame([(d.tolist(),) for d in docs], "symbols array<int>").repartition(6)
    share = np.bincount(np.concatenate(docs), minlength=v) / sum(map(len, docs))
    monkeypatch.setattr(hmm_lm, "FAN", 2)
    monkeypatch.setattr(hmm_lm, "BLOCK", 4)

    def likelihood(model):
        out = np.zeros(len(docs))
        for some, symbols, first in hmm_lm.lanes(docs):
            out[some] = hmm_lm.forward(model, symbols, first, False)[0]
        return out.sum()

    seen = [likelihood(m)]
    for _ in range(4):
        m, tokens = hmm_lm.reestimated(corpus, m, share)
        assert math.isclose(tokens, sum(map(len, docs)))
        seen.append(likelihood(m))
    assert all(b > a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 10


def judged(url, rules):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (url or "").split("://", 1)[1]) if url and "://" in url else None
    host = path = ""
    if low is not None:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1]), len(r[2])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "example.com", "x.example.com", "notexample.com", "net", "Example.NET", "b.org", "org", "ORG", "é.org", ""]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/de/8#y', '/de/', '/es/1', '?q=/en/', '#/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://x.com/en/\n://y"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    for r in url_filter.judge(pages, rules).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]], url_filter.RULES), urls[r["page_id"]]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    twice = url_filter.judge(pages.union(pages), rules).groupBy("page_id", "host", "path", "rule", "verdict").count()
    assert {r["count"] for r in twice.collect()} == {2}
    rows = [(0, "http://x.a.com/p/q"), (1, "http://a.com/p"), (2, "http://x.a.com/"), (3, "http://" + "y." * 3000 + "a.com/" + "p" * 50_000)]
    even = spark.createDataFrame([("block", "a.com", "/p"), ("allow", "x.a.com", "/p"), ("block", "b.com", "/p")], rules.schema)  # ties in path length
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), even).collect()}
    assert got == {0: ("x.a.com/p", "allow"), 1: ("a.com/p", "block"), 2: (None, "allow"), 3: ("a.com/p", "block")}


def test_cascade_is_exact(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(3000, 40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(listed, others)
    assert len(levels) > 1
    hit = url_filter.contains(F.col("key"), [levels])
    assert listed.filter(~hit).count() == 0 and others.filter(hit).count() == 0
    parts = url_filter.cascades(listed, others, max_words=200)
    hit = url_filter.contains(F.col("key"), parts)
    assert len(parts) > 2 and listed.filter(~hit).count() == 0 and others.filter(hit).count() == 0


def test_cascade_does_not_grow_with_the_universe(spark):
    listed = spark.range(5).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(5, 400_000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(listed, others)
    assert sum(x.n for x in levels) < 50
    hit = url_filter.contains(F.col("key"), [levels])
    assert listed.filter(~hit).count() == 0 and others.filter(hit).count() == 0


@pytest.mark.parametrize("block,query_part", [(8192, 16_384), (50, 3)])
def test_top_k_against_brute_force(spark, block, query_part):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [0.5] * 8) for i in range(150)] + [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [float("nan")] * 8), (2004, [math.inf] + [0.0] * 7), (2005, [None] + [0.0] * 7), (None, [1.0] * 8), (2006, [1e6] * 8), (2007, [-1e-9] * 8)]
    rows += [(3000 + i, v.tolist()) for i, v in enumerate(g.normal(size=(51, 3)))] + [(3100, [2.0]), (3101, [3.0]), (3102, [0.0] * 8)]  # other lengths, zeros
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    vectors = voronoi_knn.whole_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, voronoi_knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), pivots=6, block=block, query_part=query_part).collect()))
    fine = {i: [math.floor(1024 * e) for e in v] for i, v in rows if i is not None and v and all(e is not None and math.isfinite(e) for e in v)}
    want = []
    for q in fine:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert voronoi_knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    few = vectors.filter("vec_id in (0, 1, 2)")
    assert voronoi_knn.top_k(few, few).count() == 6


def test_top_k_scores_few_pairs_of_clustered_vectors(spark):
    g = np.random.default_rng(8)
    centres = g.normal(size=(20, 16)) * 10
    x = np.round((centres[g.integers(0, 20, 3000)] + 0.2 * g.normal(size=(3000, 16))) * 1024).astype(int)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    seen = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, voronoi_knn.top_k(vectors, vectors.filter("vec_id % 20 = 0"), scored=seen).collect()))
    s = x[::20] @ x.T
    s[np.arange(150), np.arange(0, 3000, 20)] = -(2**62)
    want = [(20 * q, n, int(i), int(s[q, i])) for q in range(150) for n, i in enumerate(np.lexsort((np.arange(3000), -s[q]))[:10], 1)]
    assert got == want
    assert 0 < seen.value < 0.2 * 150 * 3000


def test_top_k_of_repeated_rows_and_long_vectors(spark):
    rows = [(i % 5, [i % 5, 1]) for i in range(40)] + [(100, [1] * 20_000), (101, [2] * 20_000)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi_knn.top_k(vectors, vectors.filter("vec_id in (0, 100)")).collect()}
    assert [got[0, n] for n in range(1, 11)] == [(1, 1)] * 8 + [(2, 1)] * 2 and got[100, 1] == (101, 40_000) and (100, 2) not in got and len(got) == 11
