"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The tokens are a word's characters between a start and an end mark: in this kind of text most word types occur once, so
n-grams of words are nearly all unseen, while those of characters are dense. Each language has its own model. Counting is
sharded by n-gram: raw counts of the highest order and of n-grams from a word's start, continuation counts of the others,
discounts by order, context totals, and one join an order for the interpolated probabilities.

Trusted documents are those labelled good and not toxic. All of one half of them, by the ids' hashes, train the model, and
all of the other half set the thresholds: each serves for one of the two, and no threshold comes from a text that the model
was trained on. The model is sent to the tasks as sorted arrays, which take 24 bytes an n-gram at most, and a batch's new words
are looked up together. Languages go in groups of up to ``MAX_GRAMS`` n-grams, each scored in a scan of its own; documents'
n-grams are joined with the model (``score_joined``) only for a language that is larger by itself. All give the same figures.

A document has two figures: its perplexity, and its sharpest word, the lowest mean log10 probability of a word's three
least likely letters (words of letters only), which finds single foreign words in otherwise normal text. A document goes
if its perplexity is over the quantile ``q`` that trusted documents outside the training sample have in its language,
times ``slack``, or its sharpest word under their quantile ``q_word``, less ``slack_word``. Quantiles are taken over all
such documents.

Those limits come from trusted documents alone. A language with at least ``LEAST_GOOD`` trusted and ``LEAST_BAD`` rejected
labelled documents outside the training half also has limits from both kinds, for the two figures and for its
freshness (the share of distinct words in blocks of ``SPAN`` words, which a repeated word or phrase brings down). Each is that of the quantiles ``INWARD`` of trusted documents which catches most rejected ones, a trusted one lost counting ``COST`` times.

Defined results: null and empty texts have no perplexity and stay; a document in a language without a model or threshold
stays (a null language is a language); repeated rows are judged alike; without labels nothing goes; an empty table gives an
empty table; further columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, chosen, chunks, read, saved, small, text_key

ORDER, MAX_GRAMS, MAX_TYPES, PIECE = 5, 4_000_000, 600_000, 1 << 16
TRAIN_DOCS: int | None = None  # all of the training half
Q, Q_WORD, SLACK, SLACK_WORD, MIN_LETTERS = 0.995, 0.005, 1.02, 0.05, 4
BOS, EOS, FLOOR = "\x02", "\x03", 1 / 1000  # the last: the uniform share of a character
INWARD, COST, LEAST_GOOD, LEAST_BAD, SPAN = (0.999, 0.995, 0.99, 0.98, 0.97), 3, 50, 20, 64
EDGES = ".,;:!?\"'()[]{}"


def lang_of(lang: Column) -> Column:
    return F.when(lang.isNull(), "n").otherwise(F.concat(F.lit("l"), lang.cast("string")))


def train(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From (lang, text): probabilities (lang, gram, p) and back-off weights (lang, ctx, g)."""
    types = trusted.select("lang", F.explode(F.split("text", WORD_BREAK)).alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("c"))
    marked = types.withColumn("s", F.concat(F.lit(BOS), "w", F.lit(EOS)))
    ends = F.flatten(F.transform(F.sequence(F.lit(2), F.char_length("s")), lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(order))), lambda n: F.substring(F.col("s"), i - n + 1, n))))
    raw = saved(marked.select("lang", "c", F.explode(ends).alias("gram")).groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams").withColumn("n", F.char_length("gram"))
    before = raw.filter("n > 1").groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("before"))
    whole = (F.col("n") == order) | F.col("gram").startswith(BOS)
    adjusted = saved(raw.join(before, ["lang", "gram"], "left").select("lang", "gram", "n", F.when(whole, F.col("c")).otherwise(F.coalesce("before", "c")).alias("a"), F.expr("substring(gram, 1, n - 1)").alias("ctx"), F.expr("substring(gram, 2)").alias("low")), "adjusted")
    k = [F.sum((F.col("a") == i).cast("double")) for i in (1, 2, 3, 4)]
    counts = adjusted.groupBy("lang", "n").agg(*(x.alias(f"k{i}") for i, x in enumerate(k, 1)))
    y = F.col("k1") / (F.col("k1") + 2 * F.col("k2"))
    disc = [F.when((F.col(f"k{i}") > 0) & (F.col("k1") > 0), F.greatest(F.lit(0.05 * i), F.least(F.lit(0.95 * i), i - (i + 1) * y * F.col(f"k{i + 1}") / F.col(f"k{i}")))).otherwise(0.5 * i).alias(f"d{i}") for i in (1, 2, 3)]
    discounted = adjusted.join(counts.select("lang", "n", *disc), ["lang", "n"])  # a row for a language and order: the optimizer broadcasts it if it is small
    d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    discounted = discounted.withColumn("d", F.least(d, F.col("a")))
    context = discounted.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), F.sum("d").alias("off"))
    back = saved(context.select("lang", "ctx", "total", (F.col("off") / F.col("total")).alias("g")), "backoff")
    own = discounted.join(back, ["lang", "ctx"]).select("lang", "gram", "n", "low", ((F.col("a") - F.col("d")) / F.col("total")).alias("own"), "g")
    probs = done = saved(own.filter("n = 1").select("lang", "gram", (F.col("own") + F.col("g") * FLOOR).alias("p")), "order")
    for n in range(2, order + 1):
        low = done.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low"))
        done = saved(own.filter(F.col("n") == n).join(low, ["lang", "low"]).select("lang", "gram", (F.col("own") + F.col("g") * F.col("p_low")).alias("p")), "order")
        probs = probs.unionByName(done)
    return probs, back.select("lang", "ctx", "g")


class Letters:
    """A language's model as sorted arrays, a level for each length: a gram's key is its beginning's place in the level before and its last character."""

    def __init__(self, grams: pa.Table, contexts: pa.Table, order: int):
        self.order, self.levels, self.g = order, [], 0.0
        for n in range(order + 1):
            held = []
            for table in (grams, contexts):
                table = table.filter(pc.equal(pc.utf8_length(table[0]), n))
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(table)], table[0].combine_chunks()), "")[0].as_py()
                points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                held.append((self.keys(points.reshape(len(table), n)) if n else points, table[1].to_numpy()))
            (own, p), (as_context, g) = held
            if n == 0:
                self.g = float(g[0]) if len(g) else 0.0
                continue
            keys = np.union1d(own, as_context)
            self.levels.append((keys, np.full(len(keys), np.nan), np.zeros(len(keys) if n < order else 0)))  # the longest grams are no contexts
            self.levels[-1][1][np.searchsorted(keys, own)] = p
            self.levels[-1][2][np.searchsorted(keys, as_context)] = g

    def keys(self, points: np.ndarray) -> np.ndarray:
        """The keys of grams, a row each, of one character more than there are levels."""
        key = points[:, 0].astype(np.int64)
        for (level, *_), last in zip(self.levels, points.T[1:], strict=True):
            key = (np.searchsorted(level, key) << 21) + last  # a gram's beginning is a gram or a context
        return key

    def find(self, n: int, key: np.ndarray) -> np.ndarray:
        """Their places in the level of length n; -1 for what is not there."""
        level = self.levels[n - 1][0]
        if not len(level):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(level, key), len(level) - 1)
        return np.where(level[at] == key, at, -1)

    def logs(self, marked: str, first: np.ndarray) -> np.ndarray:
        """log10 probabilities of the characters of marked words, one after the other; 0 for those at `first`, the start marks."""
        points, starts, out = np.frombuffer(marked.encode("utf-32-le"), np.uint32), np.zeros(len(marked), bool), np.zeros(len(marked))
        starts[first] = True
        for a in range(0, len(points), PIECE):
            low = max(0, a - self.order + 1)  # what a piece's first characters depend on
            out[a : a + PIECE] = self.piece(points[low : a + PIECE].astype(np.int64), starts[low : a + PIECE])[a - low :]
        return out

    def piece(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        places = [self.find(1, points)]
        for n in range(2, self.order + 1):
            before = np.r_[-1, places[-1][:-1]]  # the place of what ends one character earlier
            some = np.flatnonzero((before >= 0) & ~starts)
            places.append(np.full(len(points), -1))
            places[-1][some] = self.find(n, (before[some] << 21) + points[some])
        out, off, left = np.zeros(len(points)), np.zeros(len(points)), np.flatnonzero(~starts)
        for n in range(self.order, 0, -1):  # the longest gram that is known, after the weights of longer contexts
            p = self.value(n, 1, places[n - 1][left], np.nan)
            got = ~np.isnan(p)
            out[left[got]] = off[left[got]] + p[got]
            left = left[~got]
            off[left] += self.value(n - 1, 2, places[n - 2][left - 1], 0.0) if n > 1 else self.g
        out[left] = off[left] + math.log10(FLOOR)
        return out

    def value(self, n: int, which: int, place: np.ndarray, none: float) -> np.ndarray:
        values = self.levels[n - 1][which]
        return np.where(place >= 0, values[place], none) if len(values) else np.full(len(place), none)


class Numbers(dict):
    """Words' numbers; a new word gets the next one and waits to be scored."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Of one language: by words' numbers, their log10 probability, number of predictions, and mean of the three least likely letters."""

    def __init__(self, model: Letters):
        self.model, self.numbers, self.known = model, Numbers(), np.zeros((3, 0))

    def learn(self) -> None:
        """Scores what is new."""
        new, self.numbers.new = self.numbers.new, []
        if new:
            self.known = np.concatenate([self.known, self.scored([w.decode() for w in new])], axis=1)

    def scored(self, words: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes + 2) - sizes - 2
        logs = self.model.logs(f"{BOS}{f'{EOS}{BOS}'.join(words)}{EOS}", first)
        bare = [w.strip(EDGES) for w in words]
        some = np.array([i for i, x in enumerate(bare) if len(x) >= MIN_LETTERS and x.isalpha()], np.int64)
        sharp = np.zeros(len(words))
        if len(some):
            size = np.fromiter((len(bare[i]) for i in some), np.int64, len(some))
            start = np.cumsum(size) - size
            at = first[some] + 1 + np.fromiter((words[i].index(bare[i]) for i in some), np.int64, len(some))
            letters = logs[np.repeat(at - start, size) + np.arange(size.sum())]
            letters = letters[np.lexsort((letters, np.repeat(np.arange(len(some)), size)))]
            sharp[some] = (letters[start] + letters[start + 1] + letters[start + 2]) / 3
        return np.stack([np.add.reduceat(logs, first), sizes + 1, sharp])

    def texts(self, held: list[np.ndarray]) -> np.ndarray:
        """log10, tokens, sharpest and fresh of texts, each given as its words' numbers."""
        self.learn()
        words, sizes = np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
        at = np.cumsum(sizes) - sizes
        blocks = -(-sizes // SPAN)
        block = np.repeat(np.cumsum(blocks) - blocks, sizes) + (np.arange(len(words)) - np.repeat(at, sizes)) // SPAN
        each = np.sort((block << 32) + words)
        log10, tokens, sharp = self.known[:, words]
        distinct = np.add.reduceat(np.r_[1, (each[1:] != each[:-1]).astype(np.int64)], at)
        return np.stack([np.add.reduceat(log10, at), np.add.reduceat(tokens, at), np.minimum.reduceat(sharp, at), distinct / sizes])

    def forget(self) -> None:
        self.numbers, self.known = Numbers(), np.zeros((3, 0))


SCORERS: dict[str, dict[str, Scorer]] = {}
FIGURES = "id {}, k1 long, k2 long, lang string, log10 double, tokens long, sharpest double, fresh double"


def score_sent(docs: DataFrame, probs: DataFrame, back: DataFrame, order: int = ORDER, langs: list[str] | None = None) -> DataFrame:
    """The model goes to the tasks, of some languages only if they are given. docs: (id, k1, k2, lang, text)."""
    held = {}
    for lang in [r[0] for r in probs.select("lang").distinct().collect()] if langs is None else langs:  # columns, not rows, and a language at a time
        grams = probs.filter(F.col("lang") == lang).select("gram", F.log10("p").alias("x"))
        contexts = back.filter(F.col("lang") == lang).select("ctx", F.when(F.col("g") > 0, F.log10("g")).otherwise(-99.0).alias("x"))
        held[lang] = Letters(grams.toArrow(), contexts.toArrow(), order)
    sent, mark = docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in SCORERS:  # once for each Python worker
            SCORERS.clear()
            SCORERS[mark] = {k: Scorer(m) for k, m in sent.value.items()}
        by = SCORERS[mark]
        for batch in batches:
            for start, texts in chunks(batch):
                part = batch.slice(start, len(texts))
                at: dict[str, list[int]] = {}
                numbers: dict[str, list[np.ndarray]] = {}
                for i, (lang, t) in enumerate(zip(part.column("lang").to_pylist(), texts, strict=True)):
                    words = t.split() if t and lang in by else []
                    if words:
                        at.setdefault(lang, []).append(i)
                        numbers.setdefault(lang, []).append(np.fromiter(map(by[lang].numbers.__getitem__, words), np.int64, len(words)))
                out, without = np.zeros((4, len(texts))), np.full(len(texts), True)
                for lang, rows in at.items():
                    out[:, rows], without[rows] = by[lang].texts(numbers[lang]), False
                if sum(len(x.numbers) for x in by.values()) > MAX_TYPES:
                    for x in by.values():
                        x.forget()
                cols = [pa.array(x.astype(t), mask=without) for x, t in zip(out, (np.float64, np.int64, np.float64, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "k1", "k2", "lang")] + cols, names=["id", "k1", "k2", "lang", "log10", "tokens", "sharpest", "fresh"])

    return docs.mapInArrow(run, FIGURES.format(docs.schema["id"].dataType.simpleString()))


def score_joined(docs: DataFrame, probs: DataFrame, back: DataFrame, order: int = ORDER) -> DataFrame:
    """The same with joins only, for models too large to send: word types, then their n-grams, join the model's shards."""
    key = ["id", "k1", "k2", "lang"]
    rows, docs = docs.select(*(F.col(k).alias(f"r_{k}") for k in key)), docs.dropDuplicates(key)  # repeated rows are scored once
    words = saved(docs.select(*key, F.explode(F.split("text", WORD_BREAK)).alias("w")).filter("w <> ''").groupBy(*key, "w").agg(F.count("*").alias("c")), "words")
    types = words.select("lang", "w").distinct().join(back.select("lang").distinct(), "lang", "left_semi").withColumn("s", F.concat(F.lit(BOS), "w", F.lit(EOS)))
    spots = types.select("lang", "w", "s", F.explode(F.sequence(F.lit(2), F.char_length("s"))).alias("i"))
    spots = spots.select("lang", "w", "i", "s", F.explode(F.sequence(F.lit(1), F.least("i", F.lit(order)))).alias("n")).select("lang", "w", "i", "n", F.expr("substring(s, i - n + 1, n)").alias("gram")).withColumn("ctx", F.expr("substring(gram, 1, n - 1)"))
    met = spots.join(probs, ["lang", "gram"], "left").join(back, ["lang", "ctx"], "left")
    off = F.coalesce(F.when(F.col("g") > 0, F.log10("g")), F.when(F.col("g") == 0, F.lit(-99.0)), F.lit(0.0))
    spot = met.groupBy("lang", "w", "i").agg(F.max(F.when(F.col("p").isNotNull(), F.struct("n", F.log10("p").alias("p")))).alias("best"), F.collect_list(F.struct("n", off.alias("off"))).alias("offs"))
    longer = F.filter("offs", lambda x: x["n"] > F.coalesce(F.col("best.n"), F.lit(0)))
    spot = spot.select("lang", "w", "i", (F.coalesce(F.col("best.p"), F.lit(math.log10(FLOOR))) + F.aggregate(longer, F.lit(0.0), lambda a, x: a + x["off"])).alias("x"))
    logs = spot.groupBy("lang", "w").agg(F.sum("x").alias("x"), F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
    edge = f"[{re.escape(EDGES)}]+"
    inner = F.slice(F.array_sort(F.transform(F.slice("l", F.instr("w", F.col("bare")), F.char_length("bare")), lambda y: y["x"])), 1, 3)
    logs = logs.withColumn("bare", F.regexp_replace("w", f"^{edge}|{edge}$", "")).withColumn("sharp", F.when((F.char_length("bare") >= MIN_LETTERS) & F.col("bare").rlike(r"^\p{L}+$"), F.aggregate(inner, F.lit(0.0), lambda a, y: a + y) / 3).otherwise(0.0))
    out = words.join(logs, ["lang", "w"]).groupBy(*key).agg(F.sum(F.col("c") * F.col("x")).alias("log10"), F.sum(F.col("c") * F.col("m")).alias("tokens"), F.min("sharp").alias("sharpest")).withColumnsRenamed({k: f"_{k}" for k in key})
    w = F.filter(F.split("text", WORD_BREAK), lambda x: x != "")
    distinct = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(SPAN)), F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(w, i, F.lit(SPAN)))))
    own = docs.select(*key, F.when(F.size(w) > 0, distinct / F.size(w)).alias("fresh"))
    met = own.join(out, [own[k].eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    met = rows.join(met, [F.col(f"r_{k}").eqNullSafe(met[k]) for k in key])
    return met.select(*key, "log10", "tokens", "sharpest", F.when(F.col("tokens") > 0, F.col("fresh")).alias("fresh"))


def trusted_ids(labels: DataFrame, train_docs: int | None = TRAIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Ids of trusted documents: (the half to train on, or train_docs of it; the other half)."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    train_ids = good.filter(half == 0)
    return saved(train_ids if train_docs is None else chosen(train_ids, train_docs, "doc_id"), "train"), good.filter(half == 1)


def held_out(labels: DataFrame) -> DataFrame:
    """Ids of rejected documents, toxic or of quality 0: all, but for those that another label of theirs puts into the training half."""
    bad = labels.groupBy("doc_id").agg(F.bool_or(F.expr("quality = 0 or toxic = 1")).alias("bad"), F.coalesce(F.bool_or(F.expr("quality = 1 and toxic = 0")), F.lit(False)).alias("good"))
    trained = F.col("good") & (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)
    return bad.filter("bad and doc_id is not null").filter(~trained).select("doc_id")


def grouped(sizes: dict[str, int], most: int) -> tuple[list[list[str]], list[str]]:
    """Languages in groups whose models have `most` n-grams together at most, one group at least if all fit; those that are larger by themselves."""
    groups, held = [], most + 1
    for lang, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n <= most:
            if held + n > most:
                groups.append([])
                held = 0
            groups[-1].append(lang)
            held += n
    return groups or ([] if sizes else [[]]), [lang for lang, n in sizes.items() if n > most]


def only(df: DataFrame, langs: list[str]) -> DataFrame:
    return df.filter(F.col("lang").isin(langs))


def figures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", order: int = ORDER, train_docs: int | None = TRAIN_DOCS, max_grams: int = MAX_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2, lang, log10, tokens, sharpest, fresh) of each row, and the trusted ids to take thresholds from."""
    train_ids, others = trusted_ids(labels, train_docs)
    keyed = docs.select(F.col(doc_id).alias("id"), *text_key(F.col(text)), lang_of(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    trusted = keyed.join(train_ids.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    probs, back = train(saved(trusted.select("lang", "text"), "trusted"), order)
    probs = saved(probs, "model")
    sizes = dict(probs.groupBy("lang").count().collect())  # a row for a language
    groups, large = grouped(sizes, max_grams)
    scored = [score_joined(only(keyed, large) if groups else keyed, only(probs, large), only(back, large), order)] if large else []
    for k, group in enumerate(groups):  # what has no model goes with the first
        docs = only(keyed, group) if k else keyed.filter(~F.col("lang").isin([x for x in sizes if x not in group])) if len(group) < len(sizes) else keyed
        scored.append(score_sent(docs, probs, back, order, group))
    return saved(functools.reduce(DataFrame.unionByName, scored), "figures"), others


def both_limits(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(lang, perplexity, sharpest, fresh): limits from trusted and rejected rows, of languages with enough of both."""
    worse = {"perplexity": F.col("perplexity"), "sharpest": -F.col("sharpest"), "fresh": -F.col("fresh")}
    cuts = good.groupBy("lang").agg(F.count("*").alias("good"), *(F.percentile_approx(x, list(INWARD), 10_000).alias(f"_{n}") for n, x in worse.items())).filter(F.col("good") >= LEAST_GOOD)
    caught = {n: [F.struct((F.avg((x > F.element_at(f"_{n}", i)).cast("double")) - COST * (1 - q)).alias("gain"), F.first(F.element_at(f"_{n}", i)).alias("at")) for i, q in enumerate(INWARD, 1)] for n, x in worse.items()}
    best = bad.join(small(cuts, "cuts"), "lang").groupBy("lang").agg(F.count("*").alias("bad"), *(F.greatest(*c).getField("at").alias(n) for n, c in caught.items()))
    return best.filter(F.col("bad") >= LEAST_BAD).select("lang", "perplexity", (-F.col("sharpest")).alias("sharpest"), (-F.col("fresh")).alias("fresh"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", q: float = Q, q_word: float = Q_WORD, slack: float = SLACK, slack_word: float = SLACK_WORD, **kw) -> DataFrame:
    """(id, k1, k2, lang, tokens, perplexity, sharpest, max_perplexity, min_sharpest, fresh, min_fresh, keep)."""
    rows, others = figures(docs, labels, doc_id, lang, text, **kw)
    rows = rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10") / F.col("tokens")))
    good, bad = (rows.join(x.withColumnRenamed("doc_id", "id"), "id", "left_semi").filter("tokens > 0") for x in (others, held_out(labels)))
    limits = good.groupBy("lang").agg((F.percentile_approx("perplexity", q, 10_000) * slack).alias("max_perplexity"), (F.percentile_approx("sharpest", q_word, 10_000) - slack_word).alias("min_sharpest"))
    both = both_limits(good, bad).withColumnsRenamed({"perplexity": "p", "sharpest": "s", "fresh": "min_fresh"})
    limits = limits.join(both, "lang", "left").select("lang", F.least("max_perplexity", "p").alias("max_perplexity"), F.greatest("min_sharpest", "s").alias("min_sharpest"), "min_fresh")
    gone = [F.col("perplexity") > F.col("max_perplexity"), F.col("sharpest") < F.col("min_sharpest"), F.col("fresh") < F.col("min_fresh")]
    keep = ~F.coalesce(F.array_max(F.array(*gone)), F.lit(False))  # array_max passes over nulls
    return rows.join(small(limits, "limits"), "lang", "left").withColumn("keep", keep)  # a row for a language


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", **kw) -> DataFrame:
    """docs without those that the classifier rejects."""
    bad = saved(judged(docs, labels, doc_id, lang, text, **kw).filter("not keep").select(F.col("id").alias("__id"), F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("lang").alias("__l")).distinct(), "rejected")
    a, b = text_key(F.col(text))
    match = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__1") == F.col("__a")) & (F.col("__2") == F.col("__b")) & (lang_of(F.col(lang)) == F.col("__l"))
    return docs.withColumns({"__1": a, "__2": b}).join(bad, match, "left_anti").drop("__1", "__2")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their figures."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read(spark, sf_dir, "labels")
    return judged(docs, labels).filter("keep").select(F.col("id").alias("doc_id"), "tokens", "perplexity", "sharpest", "max_perplexity", "min_sharpest")
