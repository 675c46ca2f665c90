"""The filter audit, text extraction and fill-in-the-middle against brute force, with hard rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_middle, filter_audit, html_text

DOCS = "doc_id long, text string, lang string, part string, n long, fails int, output string, k1 string"  # with clashing names
LABELS = "doc_id long, quality int, toxic int, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 7, 1, "y", "z") for i, t, lang in rows], DOCS)


def audited(rows, labels):
    """Every order replayed, document by document."""
    out = Counter()
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = {lang or "" for _, _, lang in rows}
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        good, toxic = (any(i is not None and x[0] == i and x[c] == 1 for x in labels) for c in (1, 2))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                k = (lang or "", "".join(order), step)
                out[k, "redundant"] += gone and fails[f]
                here = fails[f] and not gone
                out[k, "removed"] += here
                out[k, "good_lost"] += here and good
                out[k, "toxic_lost"] += here and toxic
                out[k, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                gone |= here
                out[k, "kept"] += not gone
    rows = {}
    for part in parts:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                shapley[f] += out[(part, "".join(order), step), "removed"]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                k = (part, "".join(order), step)
                rows[k] = (*(out[k, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[f])
    return rows


def test_audit_against_brute_force(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", long, long + " #", long.upper(), "w " * 400, "W| " * 250, "\x0b\x0c a\x1c b \t", "Ünïcode " * 3, " ".join(f"é{i}" for i in range(199)), " ".join(f"é{i}" for i in range(200)), ("word " * 99 + "X ") * 2000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(60)]
    rows += [(None, long, "en"), (None, None, None), rows[5], rows[5], (-3, long, "fr")]
    rows += [(1000 + i, long, "en") for i in range(40)]  # a text that many hold
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 70, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")]
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * 4 and {tuple(r[:3]): tuple(r[3:]) for r in got} == audited(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = frame(spark, [(1, "a", "en")]), spark.createDataFrame([(1, 1, 1, "x")], LABELS)
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    got = filter_audit.audit(docs, labels.filter("false")).agg(F.sum("good_lost"), F.sum("removed"), F.count("*")).first()
    assert tuple(got) == (0, 120, 600)


TEXTS = [None, "", "a", "ab", "naïve café", "日本語のテキスト", "👩‍👩‍👧 family 🏳️‍🌈", "a<P>b", "x <M> y", "<S>", "<", "<P", "P>", "<P >", "<Q>", "<" * 50, ">" * 9 + "<S", "é" * 30, "\x00\x7f\n\r\t", "<ß>" * 20, "é" * 200_000 + "z"]


def plain_cut(text, i):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_against_plain_ones(spark):
    rng = random.Random(2)
    rows = [(i, TEXTS[i % len(TEXTS)], "en") for i in range(20 * len(TEXTS))]
    rows += [(rng.randrange(10**12), "".join(rng.choice("<>PSMaé日👩 ") for _ in range(rng.randrange(60))), None) for _ in range(300)]
    rows += [(None, "no id at all", "en"), (-5, "minus", "en"), rows[3], rows[3]]
    docs = frame(spark, rows)
    out = fill_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter((i, t, *plain_cut(t, i)) for i, t, _ in rows)
    assert all(r["back"] == (r["text"] or "") and r["part"] == "x" for r in got)
    forms = Counter(r["form"] for r in got if r["text"] and not re.search("<[PSM]>", r["text"]))
    assert set(forms) == {"plain", "psm", "spm"} and out.columns == ["doc_id", "text", "lang", "part", "fails", "k1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_middle.fill_in_middle(docs.repartition(7)).select("output").exceptAll(out.select("output")).isEmpty()
    assert fill_middle.fill_in_middle(docs.filter("false")).count() == 0


def test_select_finds_every_set_bit():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.randrange(1, 300)
        places = sorted(rng.sample(range(width), rng.randrange(1, width + 1)))
        bits = sum(1 << p for p in places)
        assert [fill_middle.select(bits, k, width) for k in range(len(places))] == places


# --- text of pages ----------------------------------------------------------------------------------------------------

S = "Long words in a paragraph that says something of interest, at length, for readers who came for it."
PARTS = [f"{S} {S} {S}", "Short.", f"{S} {S}", "The end &amp; so on."]
BODY = "".join(f"<p>{x}</p>" for x in PARTS)
TEXT = "\n\n".join(PARTS).replace("&amp;", "&")
TITLED = f"Title\n\n{TEXT}"
PAGES = {
    "plain": (f"<nav><a>x</a> y</nav><article><h1>Title</h1>{BODY}</article><footer>z</footer>", TITLED),
    "no names": (f"<body><div class=c1><a href=/>Home</a> <a>News</a></div><div class=c2>Tag line</div><div class=c3><h1>Title</h1>{BODY}</div><div class=c4>Copyright 2020 by us</div>", TITLED),
    "headline outside": (f"<body><div id=top>Site</div><div class=w><h1>Title</h1><div class=t>{BODY}</div></div><div>Bottom</div>", TITLED),
    "sections": (f"<div class=x><div><p>Lead.</p>{BODY}</div><div>{BODY}</div></div><div class=sb><p>Weather is fine.</p></div>", f"Lead.\n\n{TEXT}\n\n{TEXT}"),
    "layout table": (f"<table><tr><td><a>l1</a><br><a>l2</a></td><td><h2>Title</h2>{BODY}</td><td>Side text</td></tr></table>", TITLED),
    "comments": (f"<article><h1>Title</h1>{BODY}<section id=comments><h2>3 Comments</h2><article class=comment><p>{S}</p></article></section></article>", TITLED),
    "comments by their headline": (f"<div class=main><div class=tx><h1>Title</h1>{BODY}</div><div class=zz><h3>Comments (2)</h3><p>{S}</p><p>{S * 4}</p></div></div>", TITLED),
    "an advert that never ends": (f"<body><div class=ad>Buy now<div class=q><h1>Title</h1>{BODY}</div>", TITLED),
    "a notice longer than the article": (f"<div id='cookie-consent'><p>{S * 5}</p></div><main><h1>T</h1><p>Ok.</p></main>", "T\n\nOk."),
    "a form around the page": (f"<form id=aspnet><div class=n><a>h</a></div><div class=c><h1>Title</h1>{BODY * 3}</div></form>", f"Title\n\n{TEXT}\n\n{TEXT}\n\n{TEXT}"),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute; &#8217; &nbsp; d&ampx 1 < 2 <3</p><ul><li>x<li>y</ul><script>var a='</article><p>no</p>';</script><!-- <p>no</p> --></article>", "a & b <c> é ’ d&x 1 < 2 <3\n\nx\n\ny"),
    "within a line": ("<article><p>Go <span class=ad>BUY <span>it</span> now</span> on <button>Click</button>now<br>then <a>link</a>.</p></article>", "Go on now then link."),
    "an aside within": (f"<main><div class=content><h1>Title</h1><aside>pull</aside>{BODY}</div><div class='sidebar'>{BODY}</div></main>", TITLED),
    "a short article": ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>Be.</p></article><form><label>a</label><input></form>", "T\n\nBe."),
    "quotes": ('<article><p title="a > b" data-x=\'<p>\'>one</p><p>two <a href="x', "one\n\ntwo"),
    "never closed": ("<article><h1>T<p><b>Bold.<br><p>Next</article><footer>no", "T\n\nBold.\n\nNext"),
    "wrapper": (f"<body class='has-sidebar'><div class='modal'><div>{BODY * 4}</div></div>", "\n\n".join([TEXT] * 4)),
    "teasers": (f"<div class=c><h1>Title</h1>{BODY}</div><div class=related-posts><article><h3>Other</h3><p>{S}</p></article></div>", TITLED),
    "parts within": (f"<div id=content><h1>Title</h1><p class=advert>{S}</p>{BODY}<ul class=share-buttons><li>Post</ul></div><ol class=comment-list><li>{S * 9}</ol><div role=complementary>{S * 9}</div>", TITLED),
    "no article": ("<nav><a>x</a></nav><footer>y</footer>", ""),
    "text alone": ("just text", "just text"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.main_text(page or "") == want


def test_window_sums():
    rng = random.Random(4)
    for _ in range(50):
        x = [rng.randrange(5) for _ in range(rng.randrange(20))]
        assert html_text.blocks(x, 3) == [sum(x[i : i + 3]) for i in range(len(x))]


def test_long_and_deep_pages_take_linear_time():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"
    assert html_text.main_text(f"<article>{'<p>word' * 30_000}</article>").count("word") == 30_000
    for odd in ("<b>x" * 20_000, "<a <a \"" * 20_000, "<" * 100_000, "<div>x<h3>Comments</h3><p>y</p></div>" * 5000):
        html_text.main_text(odd)


def test_pages_as_a_table(spark):
    rows = [(i, f"http://x/{i}", page, "t", i) for i, (page, _) in enumerate(PAGES.values())]
    rows += [rows[0], (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, k long")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "k", "text", "n_chars"]
    wants = [w for _, w in PAGES.values()]
    want = Counter((r[0], r[1], r[4], (wants[r[0]] if r[0] is not None else ""), len(wants[r[0]]) if r[0] is not None else 0) for r in rows)
    assert Counter(map(tuple, out.collect())) == want
    assert html_text.extract(pages.filter("false")).count() == 0


def test_given_pages_by_their_article(spark):
    """The given pages all have one article, with an unclosed element before a line break: what the article holds is the truth."""
    import html

    from millrace.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op12_html_text"](spark, sf).collect()}
    for i, page in pages.items():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert got[i] == "\n\n".join(x for x in parts if x)
    assert got.keys() == pages.keys()
