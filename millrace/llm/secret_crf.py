"""Secret scan: base patterns, and a linear-chain conditional random field over the words of whole texts.

The field tags each word as the begin of a secret, inside one, or outside. A word's score adds up features of its own
(shape, length, share of digits, entropy, changes of class, longest run, key words, delimiters), those of the word after it
and of the two before it, and features of the file (share of words with symbols, length, line breaks), plus one weight per pair of neighbouring tags. It learns from a
bounded sample: of about ``pool`` documents chosen by their ids' hashes, windows around the base matches of ``sample`` with
candidates, and windows of ``sample`` others; each task runs gradient steps on batches of its windows, and the weights of
all tasks are averaged, for ``rounds`` rounds.

So that it finds what the base patterns miss, each window with a base match is also learnt from ``COPIES`` masked copies: the
key word goes, or gives way to a plain word, to another key word or to one that is joined by words or an arrow; the value
stays, becomes upper case, or is replaced by a made-up one: other characters, a value behind a short prefix, parts between
dots, a login or a long key within a URI, hexadecimals, a short value (which then keeps a key word before it). In such copies the value
alone is the secret. So that not all that looks odd is a secret, windows are also learnt with decoys in place of some plain
words: addresses, dates, numbers, names of files, numbered codes, hashtags, compound words, key words before plain words. A window without a base match
that holds a word which might be a secret (``doubtful``) teaches nothing either way and is left out.

Viterbi decoding is exact over the whole text: where "outside" leads by more than changed neighbours could cost, the best
path must be outside, so the text falls into independent stretches, and only those that may hold a secret are decoded.

Defined results: a null text is empty; base matches always stay, and a decoded span that meets one adds nothing; offsets are
code points, end exclusive; repeated rows are scanned alike; without base matches to learn from no span is added; an empty
table gives an empty table; a very long text is scanned whole, in time proportional to its length; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, saved

#: The base patterns, on the text's UTF-8 bytes, and the least length of the part that counts.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
CANDIDATE = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

DIM, SAMPLE, AROUND, ROUNDS, RATE, MAX_TYPES, MAX_LOOKS, POOL, COPIES, BATCH = 8192, 1_500, 25, 4, 0.1, 300_000, 50_000, 40_000, 6, 8
OUT, BEGIN, INSIDE = range(3)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def entropy(word: bytes) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def features(word: bytes) -> list[str]:
    core = word.strip(b"\"'`.,;:()[]{}<>|!?*&%$#")
    n = len(core)
    digits, uppers, lowers = sum(48 <= c < 58 for c in core), sum(65 <= c < 91 for c in core), sum(97 <= c < 123 for c in core)
    shape = re.sub(rb"(.)\1+", rb"\1", bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 else 48 if 48 <= c < 58 else c if c < 128 else 127 for c in word[:24])).decode()
    out = ["bias", f"shape={shape}" if len(shape) <= 6 else "shape=long", f"len={min(n, 48) // 4}", f"edge={'a' if word[:1].isalnum() else 'u' if word[:1] > b'~' else word[:1].decode()}"]
    mix = (digits > 0) + (uppers > 0) + (lowers > 0)
    out += [f"mix={mix}", f"digits={round(4 * digits / n) if n else 0}", f"mix={mix}&len={min(n, 48) // 8}"]
    classes = core.translate(CLASSES)
    turns = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    run = max(RUN.findall(core), key=len, default=b"")
    parts = (run.isdigit() is False and any(48 <= c < 58 for c in run)) + 2 * (not run.islower() and not run.isupper())
    out += [f"turns={min(turns, 12)}&len={min(n, 48) // 4}", f"run={min(len(run), 40) // 4}&parts={parts}", f"dots={min(core.count(b'.'), 3)}&len={min(n, 48) // 8}"]
    if n >= SHORT and digits and uppers + lowers or n >= LONG:
        out += [f"mixed&entropy={min(int(4 * entropy(core)), 20)}&len={min(n, 32) // 4}", f"share={round(8 * digits / n)}&mix={mix}&len={min(n, 32) // 8}", f"share={round(8 * digits / n)}&turns={min(turns, 12)}"]
    if b"://" in word:
        out += ["uri", f"login={LOGIN.search(word) is not None}"]
    if n >= LONG:
        out += [f"entropy={min(int(2 * entropy(core)), 10)}", f"hex={re.fullmatch(rb'[0-9a-fA-F]+', core) is not None}", f"mix={mix}&entropy={min(int(2 * entropy(core)), 10)}", f"all={'d' if digits == n else 'a' if digits == 0 else 'm'}"]
    low = core.lower().replace(b"_", b"").replace(b"-", b"")
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"key", b"auth", b"bearer", b"credential", b"kennwort", b"passwort", b"contrase", b"clave")) or low in (b"pass", b"passe", b"pwd", b"passphrase", b"login", b"code"):
        out.append("keyword")
    out += [f"has={c}" for c in "=:@/_-+." if c.encode() in word] + ([f"only={word.decode('latin1')}"] if word in (b"=", b":", b"=>", b":=") else [])
    return out


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def file_features(words: int, symbols: int, lines: int) -> list[int]:
    return [slot(f"file:symbols={min(int(20 * symbols / max(1, words)), 10)}"), slot(f"file:words={min(words, 1 << 14).bit_length()}"), slot(f"file:lines={min(int(10 * lines / max(1, words)), 10)}")]


SYMBOL = re.compile(rb"[=|*&%$#{}<>]")
RUN = re.compile(rb"[A-Za-z0-9]+")
LOGIN = re.compile(rb"://[^/@]*:[^/@]+@")

#: Letters and digits by class, other ASCII as it is.
CLASSES = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 else 48 if 48 <= c < 58 else c if c < 128 else 127 for c in range(256))
KEYWORD = re.compile(rb"pass|pwd|login|secret|token|key|auth|bearer|credential|code|kennwort|contrase|clave", re.IGNORECASE)
MIXED = re.compile(rb"(?=.*[0-9]).*[A-Za-z]", re.DOTALL)
LONG, SHORT = 16, 8


def look_of(word: bytes) -> bytes:
    """What a word's features depend on: of long, mixed and key words the word itself, of others the classes of its characters."""
    return word if len(word) >= LONG or len(word) >= SHORT and MIXED.match(word) or KEYWORD.search(word.translate(None, b"-_") if b"-" in word or b"_" in word else word) else word.translate(CLASSES)


#: Prefixes of a word's features by where it stands: the word itself, before, after, two before.
PLACES = ("", "-", "+", "--")


class Types:
    """Scores of words as themselves (0), as the one before (1), the one after (2) and the one two before (3); short words of the same look share a row."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.of, self.looks, self.scores, self.symbol, self.array = weights, {}, {}, [], [], None

    def __getitem__(self, word: bytes) -> int:
        found = self.of.get(word)
        if found is None:
            look = look_of(word)
            found = self.looks.get(look)
            if found is None:
                found = self.looks[look] = len(self.scores)
                names = features(look)
                self.scores.append([self.weights[[slot(p + n) for n in names]].sum(0) for p in PLACES])
                self.symbol.append(SYMBOL.search(word) is not None)
                self.array = None
            self.of[word] = found
        return found

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.array is None:
            self.array = np.array(self.scores, float).reshape(-1, len(PLACES), 3), np.array(self.symbol, bool)
        return self.array


def viterbi(score: np.ndarray, move: np.ndarray, after: int = OUT) -> list[int]:
    """The best tags of a stretch between words outside."""
    best, back = move[after] + score[0], []
    for s in score[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(0))
        best = ways.max(0) + s
    tag = int((best + move[:, OUT]).argmax())
    tags = [tag]
    for b in reversed(back):
        tags.append(tag := int(b[tag]))
    return tags[::-1]


def tagged(score: np.ndarray, move: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) words of the secrets in the best path of a whole text."""
    reach = 2 * float(move.max() - move.min())
    lead = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE])
    open_ = np.flatnonzero(lead <= reach)
    out = []
    if len(open_):
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags = viterbi(score[part[0] : part[-1] + 1], move)
            at = None
            for i, t in enumerate([*tags, OUT]):
                if at is not None and t != INSIDE:
                    out.append((int(part[0]) + at, int(part[0]) + i - 1))
                    at = None
                if t != OUT and at is None:
                    at = i
    return out


def windows(text: bytes, spans: list[tuple[int, int, int]], around: int = AROUND) -> Iterator[tuple[list[bytes], list[int]]]:
    """(words, tags) around the spans of a text, or one window of a text without any."""
    at = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    tags = [OUT] * len(at)
    starts = np.array([a for a, _, _ in at])
    marked = []
    for s, e, _ in sorted(spans):
        i = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
        first = True
        while i < len(at) and at[i][0] < e:
            if at[i][1] > s and tags[i] == OUT:
                tags[i] = BEGIN if first else INSIDE
            marked.append(i)
            first, i = False, i + 1
    done = -1
    for i in marked or ([zlib.crc32(text) % len(at)] if at else []):
        if i > done:
            lo, done = max(done + 1, i - around, 0), min(len(at) - 1, i + around)
            yield [w for _, _, w in at[lo : done + 1]], tags[lo : done + 1]


VALUE = re.compile(rb"[A-Za-z0-9+/_.-]+")
#: A long run of letters and digits, in quotes or not; a login within a URI.
DOUBTFUL = re.compile(rb"""["'`]?(?=[A-Za-z.+/_-]*[0-9])(?=[0-9.+/_-]*[A-Za-z])[A-Za-z0-9.+/_-]{16,}={0,2}["'`]?|.*://[^/@]*:[^/@]+@.*""")

#: What masked copies and decoys are made of.
LOWER, DIGIT = b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
ALNUM = LOWER + LOWER.upper() + DIGIT
CUES = (b"password", b"passphrase", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"login", b"code", b"Kennwort", b"Passwort", "contraseña".encode(), b"clave", b"passe")
JOINTS = ((), (b"is",), (b"->",), (b"=>",), (b"was",), (b"now",), (b":",), (b"lautet",), (b"es",), (b"est",))


def doubtful(words: list[bytes]) -> bool:
    """Whether a window may hold a secret that no base pattern matches."""
    return any(DOUBTFUL.fullmatch(w) or len(w) >= SHORT and MIXED.match(w) and any(map(KEYWORD.search, words[max(0, i - 2) : i])) for i, w in enumerate(words))


def made(rng: random.Random, alphabet: bytes, least: int, most: int) -> bytes:
    return bytes(rng.choices(alphabet, k=rng.randint(least, most)))


def disguised(value: bytes, rng: random.Random) -> bytes:
    """A value as it is, in upper case, or one of another form in its place."""
    form = rng.randrange(13)
    if form < 2:
        return value.upper() if form else value
    if form == 2:
        return made(rng, ALNUM + b"+/", LONG, 48)
    if form == 3:
        return made(rng, ALNUM, LONG, 40)
    if form == 4:
        joint = rng.choice((b"_", b"-"))
        return joint.join([made(rng, LOWER, 2, 5) for _ in range(rng.randint(1, 2))] + [made(rng, ALNUM, LONG, 40)])
    if form == 5:
        return b".".join(made(rng, ALNUM + b"_-", 10, 40) for _ in range(rng.randint(2, 3)))
    if form == 6:
        return b"%s://%s:%s@%s.%s/%s" % (made(rng, LOWER, 3, 8), made(rng, LOWER, 3, 8), made(rng, ALNUM + b"!$._-", 6, 20), made(rng, LOWER, 3, 9), made(rng, LOWER, 2, 7), made(rng, LOWER, 0, 6))
    if form == 7:
        return made(rng, b"0123456789" + rng.choice((b"ABCDEF", b"abcdef")), 20, 64)
    if form == 8:
        return b"https://%s.%s/%s%s%s" % (made(rng, LOWER, 3, 9), made(rng, LOWER, 2, 7), made(rng, LOWER, 3, 8), rng.choice((b"/", b"?%s=" % made(rng, LOWER, 2, 6))), made(rng, ALNUM + b"_-", 24, 48))
    if form == 9:
        return made(rng, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", LONG, 52)
    if form == 10:
        return b":".join(made(rng, b"0123456789abcdef", 2, 2) for _ in range(rng.choice((16, 20, 32))))
    return made(rng, (ALNUM + b"!$%&@#", LOWER + DIGIT)[form - 11], SHORT, LONG)


def plain(word: bytes) -> bool:
    return word.isalpha() or len(word) < SHORT


def plain_word(words: list[bytes], tags: list[int], rng: random.Random) -> bytes:
    return rng.choice([w for w, t in zip(words, tags, strict=True) if t == OUT and plain(w)] or [b"is"])


def masked(words: list[bytes], tags: list[int], copy: int = 0) -> tuple[list[bytes], list[int]]:
    """A window whose secrets have lost their cue, and maybe their form; which of the ways is up to the value's hash and the copy."""
    out: list[tuple[bytes, int]] = []
    i = 0
    while i < len(words):
        j = i + 1
        if tags[i] == BEGIN:
            while j < len(words) and tags[j] == INSIDE:
                j += 1
            value = max(VALUE.findall(max(words[i:j], key=len)), key=len, default=b"")
            rng = random.Random(zlib.crc32(value) + (copy << 32))
            value = disguised(value, rng)
            if len(value) <= LONG or rng.random() < 0.4:
                cue = rng.choice(CUES)
                before = [rng.choice((cue, cue.title(), cue.upper())), *rng.choice(JOINTS)]
            else:
                before = rng.choice(([], [plain_word(words, tags, rng)], [plain_word(words, tags, rng), b"->"]))
            out += [(w, OUT) for w in before] + [(rng.choice((b"%s", b"%s", b'"%s"', b"'%s'", b"%s.", b"%s,")) % value, BEGIN)]
        else:
            out.append((words[i], tags[i]))
        i = j
    return [w for w, _ in out], [t for _, t in out]


def decoy(rng: random.Random, word: bytes, other: bytes) -> list[bytes]:
    """Words that are no secret though they look odd, made of two plain words and digits."""
    host = b".".join([made(rng, LOWER, 3, 8) + made(rng, DIGIT, 0, 1) for _ in range(rng.randrange(2))] + [made(rng, LOWER, 4, 12), made(rng, LOWER, 2, 4)])
    low, number = word.lower(), made(rng, DIGIT, 1, 6)
    return [
        [b"https://%s/%s/%s-%s" % (host, low, other.lower(), number)],
        [b"http://%s:%d/%s?id=%s" % (host, rng.randrange(1000, 9999), low, number)],
        [b"%s.%s@%s" % (low, number[:2], host)],
        [b"20%02d-%02d-%02dT%02d:%02d:00Z" % tuple(rng.randrange(1, n) for n in (30, 12, 28, 24, 60))],
        [made(rng, DIGIT, 8, 19)],
        [b"v%d.%d.%d" % tuple(rng.randrange(20) for _ in range(3))],
        [b"10.%d.%d.%d" % tuple(rng.randrange(256) for _ in range(3))],
        [b"%s_%s_%s.pdf" % (low, other.lower(), number)],
        [b"%s-%s" % (word.upper()[:4], made(rng, DIGIT, 4, 9))],
        [b"%s%s%s" % (low, other.title(), rng.choice((b"", number[:2])))],
        [b"%s_%s_of_%s" % (low, other.lower(), low)],
        [b"+%d-%s-%s" % (rng.randrange(1, 99), made(rng, DIGIT, 3, 3), made(rng, DIGIT, 4, 7))],
        [(word + other).upper() + b"!!"],
        [b":".join(made(rng, b"0123456789abcdef", 2, 2) for _ in range(rng.choice((6, 8))))],
        [b"#%s%s%s" % (word.title(), other.title(), made(rng, DIGIT, 0, 4))],
        [made(rng, LOWER, 2, 3).upper() + made(rng, DIGIT, 8, 24)],
        [rng.choice(CUES), *rng.choice(JOINTS), word],
        [rng.choice(CUES), *rng.choice(JOINTS), (word + other).lower()],
    ][rng.randrange(18)]


def decoyed(words: list[bytes], tags: list[int], copy: int = 0) -> tuple[list[bytes], list[int]]:
    """A window with decoys in place of about one plain word in twelve."""
    rng = random.Random(zlib.crc32(b" ".join(words)) + (copy << 32))
    out: list[tuple[bytes, int]] = []
    for w, t in zip(words, tags, strict=True):
        swap = t == OUT and plain(w) and rng.random() < 1 / 12
        out += [(x, OUT) for x in decoy(rng, w, plain_word(words, tags, rng))] if swap else [(w, t)]
    return [w for w, _ in out], [t for _, t in out]


def learnt(window: tuple[list[bytes], list[int]]) -> list[tuple[list[bytes], list[int]]]:
    """What a window teaches: itself, and its copies with masks and decoys."""
    if BEGIN in window[1]:
        return [window, *(masked(*(decoyed(*window, c) if c else window), c) for c in range(COPIES))]
    return [] if doubtful(window[0]) else [window, decoyed(*window)]


def batched(data: list[tuple], size: int = BATCH) -> list[tuple]:
    """Windows (features of each word, features of the file, tags) as batches of like lengths: features of all words one after
    the other, where each word's begin, their number, the words' windows and places, tags, features of the files, most words."""
    out = []
    data = sorted(data, key=lambda x: len(x[2]))  # stable
    for part in (data[i : i + size] for i in range(0, len(data), size)):
        n = np.array([len(tags) for _, _, tags in part])
        counts = np.array([len(f) for own, _, _ in part for f in own])
        out.append((np.concatenate([f for own, _, _ in part for f in own]), np.cumsum(counts) - counts, counts, np.repeat(np.arange(len(part)), n), np.concatenate([np.arange(x) for x in n]), np.concatenate([tags for _, _, tags in part]), np.array([file for _, file, _ in part]), int(n.max())))
    return [out[i] for i in np.random.default_rng(len(out)).permutation(len(out))]


def gradient(batch: tuple, weights: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch, the conditional log-likelihood's gradient by word and tag and by move, and log Z by window.

    Shorter windows are filled up with words that must be outside; these add the same to every path.
    """
    flat, at, _, which, when, tags, file, most = batch
    score = np.full((len(file), most, 3), -1e9)
    score[:, :, OUT] = 0
    score[which, when] = np.add.reduceat(weights[flat], at) + weights[file].sum(1)[which]
    a, b = np.empty_like(score), np.empty_like(score)
    a[:, 0], b[:, -1] = score[:, 0] + move[OUT], move[:, OUT]
    for t in range(1, most):
        a[:, t] = np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1) + score[:, t]
    for t in range(most - 2, -1, -1):
        b[:, t] = np.logaddexp.reduce(move + (score[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(a[:, -1] + b[:, -1], axis=1)
    grad = -np.exp(a + b - z[:, None, None])[which, when]
    grad[np.arange(len(tags)), tags] += 1
    later = np.flatnonzero(when)
    w, t = which[later], when[later]
    m = -np.exp(a[w, t - 1][:, :, None] + move + (score[w, t] + b[w, t])[:, None, :] - z[w, None, None]).sum(0)
    np.add.at(m, (tags[later - 1], tags[later]), 1)
    return grad, m, z - (most - np.bincount(which, minlength=len(file))) * move[OUT, OUT]


def epoch(batches: list[tuple], weights: np.ndarray, move: np.ndarray, square: np.ndarray, rate: float = RATE) -> None:
    """A gradient step for each batch, in place."""
    for batch in batches:
        flat, _, counts, which, _, _, file, _ = batch
        grad, m, _ = gradient(batch, weights, move)
        for places, g, step in ((flat, np.repeat(grad, counts, axis=0), rate), (file.ravel(), np.repeat(np.array([np.bincount(which, grad[:, k], len(file)) for k in range(3)]).T, file.shape[1], axis=0), 0.1 * rate)):
            some = np.flatnonzero(np.abs(g).max(axis=1) > 1e-3)
            total = np.array([np.bincount(places[some], g[some, k], DIM) for k in range(3)]).T
            rows = np.flatnonzero(total.any(axis=1))
            square[rows] += total[rows] ** 2
            weights[rows] += step * total[rows] / np.sqrt(square[rows] + 1e-6) - 1e-5 * weights[rows]
        move += 0.02 * rate * m


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, pool: int = POOL) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (features x tags) and moves (tag x tag). docs: (id, text)."""
    def part(name: str, n: float, of: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1 << 30)) < int(min(1.0, n / max(1, of)) * (1 << 30))

    total = docs.count()
    seen = docs.filter(part("pool", pool, total) & F.col("text").isNotNull()).select("id", "text", F.col("text").rlike(CANDIDATE).alias("hit"))
    kept = saved(seen.filter(F.col("hit") | part("rest", sample, min(pool, total))), "secrets")
    hits = kept.filter("hit").count()
    kept = kept.filter(~F.col("hit") | part("hit", sample, hits)).select("id", "text").repartition(6, F.xxhash64("id", "text")).sortWithinPartitions("id", "text")
    weights, move = np.zeros((DIM, 3)), np.zeros((3, 3))
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((weights, move))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, m, data, found, known = sent.value[0].copy(), sent.value[1].copy(), [], 0, {}
            for batch in batches:
                for _, texts in chunks(batch):
                    for t in texts:
                        spans = base_spans(t or b"")
                        words = (t or b"").split()
                        file = file_features(len(words), sum(SYMBOL.search(x) is not None for x in words), (t or b"").count(b"\n"))
                        for ws, tags in (x for w in windows(t or b"", spans) for x in learnt(w)):
                            fs = []
                            for x in ws:
                                if x not in known:
                                    names = features(x)
                                    known[x] = [np.array([slot(p + n) for n in names], np.int32) for p in PLACES]
                                fs.append(known[x])
                            data.append(([np.concatenate([f[0], *(f2[k] for k, f2 in ((1, fs[i - 1] if i else None), (2, fs[i + 1] if i + 1 < len(fs) else None), (3, fs[i - 2] if i > 1 else None)) if f2)]) for i, f in enumerate(fs)], file, np.array(tags)))
                            found += sum(x == BEGIN for x in tags)
            if found:
                square, parts = np.zeros_like(w), batched(data)
                for _ in range(3):
                    epoch(parts, w, m, square)
                yield pa.RecordBatch.from_arrays([pa.array([w.ravel()], pa.list_(pa.float64())), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["w", "m"])

        got = kept.mapInArrow(run, "w array<double>, m array<double>").collect()  # the model's size for each of the sample's tasks
        if not got:
            return None
        weights, move = np.mean([r["w"] for r in got], axis=0).reshape(DIM, 3), np.mean([r["m"] for r in got], axis=0).reshape(3, 3)
    return weights, move


def overlapped(base: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> tuple[set[int], list[tuple[int, int]]]:
    """(places of the base spans that found ones meet, found ones that meet none). Spans of one kind are disjoint and in order."""
    met, free = set(), np.full(len(found), True)
    for kind in range(3):
        mine = [i for i, b in enumerate(base) if b[2] == kind]
        starts, ends = np.array([base[i][0] for i in mine]), np.array([base[i][1] for i in mine])
        for n, (s, e) in enumerate(found if mine else ()):
            lo, hi = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e))
            if lo < hi:
                free[n] = False
                met.update(mine[lo:hi])
    return met, [f for f, ok in zip(found, free.tolist(), strict=True) if ok]


def code_points(text: bytes, places: set[int]) -> dict[int, int]:
    out, before, n = {}, 0, 0
    for x in sorted(places):
        n += len(text[before:x].decode())
        out[x] = n
        before = x
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """Of each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf (spans that the field adds) and n_met (base matches it finds by itself)."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    model = train(keyed, sample, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, move = sent.value or (np.zeros((DIM, 3)), None)
        types = Types(weights)
        for batch in batches:
            for start, texts in chunks(batch):
                if len(types.of) > MAX_TYPES or len(types.scores) > MAX_LOOKS:
                    types = Types(weights)
                words = [(t or b"").split() for t in texts]
                ids = [np.fromiter(map(types.__getitem__, w), np.int32, len(w)) for w in words] if move is not None else []
                (scores, symbol), rows = types.arrays(), []
                for i, t in enumerate(texts):
                    base = base_spans(t or b"")
                    spans, met = list(base), set()
                    if move is not None and len(words[i]):
                        x = ids[i]
                        score = scores[x, 0] + weights[file_features(len(x), int(symbol[x].sum()), t.count(b"\n"))].sum(0)
                        score[1:] += scores[x[:-1], 1]
                        score[:-1] += scores[x[1:], 2]
                        score[2:] += scores[x[:-2], 3]
                        if found := tagged(score, move):
                            at = [(m.start(), m.end()) for m in WORD.finditer(t)]
                            met, free = overlapped(base, [(at[a][0], at[b][1]) for a, b in found])
                            spans += [(s, e, 3) for s, e in free]
                    points = code_points(t or b"", {x for s in spans for x in s[:2]})
                    spans = [(points[s], points[e], k) for s, e, k in spans]
                    own = joined([x for x in spans if x[2] < 3])
                    rows.append((*(sum(k == n for _, _, k in spans) for n in range(3)), hashlib.sha256(own.encode()).hexdigest(), joined(spans), sum(k == 3 for _, _, k in spans), len(met)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(texts)), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_met"])

    return keyed.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_met long")


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
