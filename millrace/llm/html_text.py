"""Main text of web pages by the distribution of text over lines.

Each page goes through three steps.

1. Markup is stripped. Block elements begin and end lines; scripts, styles, comments of the markup and forms go, and so do
   lines within elements that say themselves to be navigation, header, footer, sidebar, notice, advert or reader comments,
   by tag, role, class or id. Text in links counts nothing, so a list of links is a flat stretch.
2. Lengths are summed over windows of ``WINDOW`` lines. ``WINDOW`` empty lines stand wherever the section (the innermost
   element that holds several blocks) changes, so the sum falls to nothing there: a line where it rises from nothing is a
   surge point, where it falls back a dive point.
3. The stretch with most text is the core. Where it lies in the page's article, the points move out to the article's ends.
   Elsewhere they move out over sections beside the core while these rise to a share of its height and bring a share of its
   text. The text between the first surge and the last dive point is kept, with a headline right before it.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line, in page
order. Nothing between the points is dropped or shortened but what step 1 removes.

Defined results: a null or empty page has an empty text, and so has one of boilerplate alone; markup that is cut off or
never closed ends with the page; an element by whose class most of the page would go, and one never closed that holds more
than all else, is not taken at its word; repeated rows are treated alike; a very long page takes time in proportion to its length;
an empty table gives an empty table; elements over 400 deep count as part of the 400th; further columns pass through, but for
text and n_chars, which are replaced.
"""

from __future__ import annotations

import html as markup
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, read

WINDOW = 3
RISE, BESIDE = 0.3, 0.25  # of the core: the height that a section beside it needs, and the text that an element around both must add
MOST, LARGE = 0.8, 1000  # a class or form that would take more than this share, and characters, of a page is not believed
BYLINE = 300  # characters between a headline and the core
DEEPEST = 400  # elements within each other; what is deeper counts as part of the last

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Kinds of elements of HTML. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside body center details div fieldset footer form header html main section td th".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: What an opening tag closes, and within what.
CLOSES = {t: ({t}, frozenset({"ul", "ol", "menu"})) for t in ("li",)} | {t: ({"dt", "dd"}, frozenset({"dl"})) for t in ("dt", "dd")} | {t: ({"td", "th"}, frozenset({"table", "tr"})) for t in ("td", "th")} | {"tr": ({"tr"}, frozenset({"table"})), "option": ({"option"}, frozenset({"select"}))}
MUTE_TAGS = frozenset("nav footer aside form button select datalist label svg canvas object audio video dialog menu search".split())
MUTE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Words in classes and ids of what is no article, and of comments.
MUTE_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu dropdown breadcrumb breadcrumbs pagination pager tabs skip masthead topbar toolbar footer colophon copyright sidebar aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertisements advertising advertorial adsense sponsor sponsored sponsors promo promos promotion promotions promoted banner banners taboola outbrain "
    "cookie cookies consent gdpr privacy notice notices notification notifications popup popups modal overlay lightbox toast alert paywall disclaimer newsletter subscribe subscription signup signin "
    "login register search form share sharing social related recommended recommendations trending popular".split()
)
ASIDE_WORDS = frozenset("sidebar aside rail widget widgets footer promo promos promoted sponsor sponsored related recommended recommendations trending popular".split())
COMMENT_WORDS = frozenset("comment comments commentlist commenter disqus respond responses reply replies discussion kommentar kommentare commentaires comentarios".split())
LAYOUT_WORDS = frozenset("has with without no not layout open closed enabled disabled left right wrapper page body overflow".split())
HIDDEN_NAMES = frozenset("hidden d-none visually-hidden sr-only screen-reader-text".split())
ARTICLE_NAME = re.compile(r"(?:(?:the|main|blog|news|single)[-_]?)?(?:article|post|entry|story)(?:[-_]?(?:body|content|text|main))?|(?:article|post|entry|story)[-_]?(?:inner|detail)", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMENTS_TITLE = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?)\W*(?:\d+\W*)?|(?:leave|post|write|add) (?:a|your) (?:comment|reply)\W*|"
    r"(?:related|recommended|more|similar) (?:articles|posts|stories|news|reading)\W*", re.I
)

NONE, SAID, CLASS, COMMENTS, ASIDE = range(5)  # why an element is muted: not, by tag or role, by class or form, as reader comments, by a class of what may hold articles of its own


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    why: int
    mute: int  # the innermost muted element that holds it, or -1
    article: bool
    within: bool  # it is, or lies in, an article or main part
    blocks: int = 0  # block elements right within
    ended: bool = False  # by its own end tag
    last: int = -1  # the last element within it; elements are numbered in page order


@dataclass(slots=True)
class Line:
    text: str
    plain: int  # characters outside links
    node: int
    mute: int


def _judged(tag: str, rest: str, within: bool) -> tuple[int, bool]:
    """(why the element is muted, whether it is an article). within: an article holds it."""
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    names = f"{at.get('class', '')} {at.get('id', '')}".split()
    said = tag in ("html", "body", "article", "main")
    if "hidden" in at and at["hidden"].lower() != "until-found" or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I) or HIDDEN_NAMES.intersection(names):
        return (NONE if tag in ("html", "body") else SAID), False
    why = NONE
    for name in names:
        words = [w.lower() for w in NAME_WORD.findall(name)]
        if LAYOUT_WORDS.intersection(words):
            continue
        if COMMENT_WORDS.intersection(words):
            return (NONE if tag in ("html", "body") else COMMENTS), False
        if not said and (MUTE_WORDS.intersection(words) or "header" in words and not within and not {"article", "post", "entry", "story"}.intersection(words)):
            why = ASIDE if ASIDE_WORDS.intersection(words) else CLASS
    if tag == "form":
        why = CLASS
    elif tag in MUTE_TAGS or at.get("role", "").lower() in MUTE_ROLES or tag == "header" and not within:
        why = SAID
    article = tag == "article" or at.get("itemprop", "") == "articleBody" or tag in ("div", "section", "td", "main") and any(ARTICLE_NAME.fullmatch(n) for n in names)
    return why, article and not why


def lines_of(page: str) -> tuple[list[Line], list[Node]]:
    """The page's lines and elements. An element that is no block ends no line."""
    nodes, lines = [Node("html", -1, NONE, -1, False, False, ended=True)], []
    stack, links, pieces, plain, home = [0], 0, [], 0, 0

    def flush() -> None:
        nonlocal pieces, plain
        if text := " ".join("".join(pieces).split()):
            lines.append(Line(text, plain, home, nodes[home].mute))
        pieces, plain = [], 0

    def put(text: str) -> None:
        nonlocal plain, home
        top = stack[-1]
        if not text or nodes[top].mute >= 0 and nodes[nodes[top].mute].tag not in BLOCK:
            return  # in a muted element within a line
        text = markup.unescape(text) if "&" in text else text
        if not pieces:
            if text.isspace():
                return
            home = next(k for k in reversed(stack) if nodes[k].tag in BLOCK)
        pieces.append(text)
        plain += 0 if links else len(text) - text.count(" ")

    def pop(to: int) -> None:
        """Elements from place `to` of the stack on end."""
        nonlocal links
        for k in stack[to:]:
            links -= nodes[k].tag == "a"
            nodes[k].last = len(nodes) - 1
        del stack[to:]

    def above(tags: set[str] | frozenset[str], walls: frozenset[str]) -> int:
        """The place in the stack of the innermost of the tags, not beyond a wall; 0 if there is none."""
        for i in range(len(stack) - 1, 0, -1):
            if nodes[stack[i]].tag in tags:
                return i
            if nodes[stack[i]].tag in walls:
                return 0
        return 0

    at = 0
    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag in BLOCK:
                walls = frozenset() if tag in TABLE else frozenset({"td", "th"}) | (CONTAINER if tag == "p" else frozenset())
                flush()
                if i := above({tag}, walls):
                    nodes[stack[i]].ended = True
                    pop(i)
            elif i := above({tag}, BLOCK):
                pop(i)
            continue
        if tag in RAW:
            ended = re.compile(f"</{tag}(?![a-z0-9])[^>]*+(?:>|\\Z)", re.I).search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if tag == "br":
            put(" ")
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body") and (i := above({"p"}, CONTAINER)):
                pop(i)
            if tag in CLOSES and (i := above(*CLOSES[tag])):
                pop(i)
        elif tag == "a" and (i := above({"a"}, BLOCK)):
            pop(i)
        if tag in VOID or tag == "html" or m[3].endswith("/") and tag not in BLOCK:
            continue
        parent = stack[-1]
        if tag in BLOCK:
            nodes[parent if nodes[parent].tag in BLOCK else next(k for k in reversed(stack) if nodes[k].tag in BLOCK)].blocks += 1
        why, article = _judged(tag, m[3], nodes[parent].within)
        outer = nodes[parent].mute
        inline = nodes[parent].tag not in BLOCK and nodes[parent].tag != "a"  # the element around is muted, so end tags must be told apart
        if len(stack) >= DEEPEST or not (tag in BLOCK or tag == "a" or why or inline):
            continue
        # what says to be the article is believed rather than an element around it, but not within comments
        mute = len(nodes) if why else -1 if (tag in ("article", "main")) and outer >= 0 and nodes[outer].why == CLASS else outer
        nodes.append(Node(tag, parent, why, mute, article, nodes[parent].within or article or tag == "main"))
        stack.append(len(nodes) - 1)
        links += tag == "a"
    put(page[at:])
    flush()
    pop(0)
    return lines, nodes


def _believed(lines: list[Line], nodes: list[Node]) -> None:
    """Lines muted by a class that would take most of the page, or by an element that never ends and holds more than all else, are heard again."""
    total, by = sum(x.plain for x in lines), defaultdict(int)
    for x in lines:
        by[x.mute] += x.plain
    for k, n in by.items():
        if k >= 0 and nodes[k].why in (CLASS, ASIDE):
            unended = not nodes[k].ended and 2 * n > total
            if unended or n > MOST * total and n > LARGE:
                for x in lines:
                    if x.mute == k and not (unended and _container(nodes, x.node) == k):
                        x.mute = -1


def _container(nodes: list[Node], k: int) -> int:
    while k > 0 and nodes[k].tag not in CONTAINER:
        k = nodes[k].parent
    return max(k, 0)


def _section(nodes: list[Node], k: int) -> int:
    """The innermost element around k that holds several blocks, or one and text: an element that holds text alone is a paragraph."""
    k = _container(nodes, k)
    while k > 0 and not nodes[k].blocks:
        k = _container(nodes, nodes[k].parent)
    return k


def _inside(nodes: list[Node], k: int, outer: int) -> bool:
    return outer <= k <= nodes[outer].last


def _comments_end_it(lines: list[Line], nodes: list[Node], sections: list[int]) -> None:
    """From a headline over reader comments or further reading on, the rest of its section is muted."""
    for i, x in enumerate(lines):
        if x.mute < 0 and nodes[x.node].tag in ("h2", "h3", "h4", "h5", "h6") and COMMENTS_TITLE.fullmatch(x.text):
            for j in range(i, len(lines)):
                if not _inside(nodes, sections[j], sections[i]):
                    break
                lines[j].mute = 0


def blocks(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sums over windows of lines, by the line that they begin at."""
    out, held = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        held += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        out[i] = held
    return out


@dataclass(slots=True)
class Stretch:
    """Lines first to last between a surge and a dive point, of one section."""

    first: int
    last: int
    section: int
    size: int
    height: int


def stretches(lines: list[Line], sections: list[int], window: int = WINDOW) -> list[Stretch]:
    """The stretches of lines over which the window sums stay above nothing."""
    lengths, places, before = [], [], None
    for i, x in enumerate(lines):
        if x.mute >= 0:
            continue
        if before is not None and sections[i] != before:
            lengths += [0] * window
            places += [-1] * window
        before = sections[i]
        lengths.append(x.plain)
        places.append(i)
    sums, out, first = blocks(lengths, window), [], None
    for i in range(len(lengths) + 1):
        rest = sums[i] if i < len(lengths) else 0
        if rest and first is None and lengths[i]:
            first = i  # surge
        elif not rest and first is not None:  # dive
            held = [k for k in range(first, i) if lengths[k]]
            out.append(Stretch(places[held[0]], places[held[-1]], sections[places[held[0]]], sum(lengths[first:i]), max(sums[first:i])))
            first = None
    return out


def _menus(lines: list[Line]) -> set[int]:
    """Lines of three or more in a row that are links alone."""
    out, run = set(), []
    for i, x in enumerate([*lines, Line("", 1, 0, -1)]):
        if x.mute < 0 and not x.plain:
            run.append(i)
        elif x.mute < 0:
            out.update(run if len(run) >= WINDOW else ())
            run = []
    return out


def kept_lines(lines: list[Line], nodes: list[Node]) -> list[int]:
    """The lines between the first surge and the last dive point."""
    _believed(lines, nodes)
    sections = [_section(nodes, x.node) for x in lines]
    _comments_end_it(lines, nodes, sections)
    heard = [i for i, x in enumerate(lines) if x.mute < 0]
    found = stretches(lines, sections)
    core = max(found, key=lambda s: s.size, default=None)

    def article_of(k: int) -> int:
        best = 0
        while k > 0:
            best, k = (k if nodes[k].article else best), nodes[k].parent
        return best

    articles = {a for i in heard if (a := article_of(lines[i].node))}
    one = article_of(core.section) if core else 0
    if len(articles) == 1 or not core and articles:
        one = max(articles, key=lambda a: sum(len(lines[i].text) for i in heard if article_of(lines[i].node) == a))
    menus = _menus(lines)
    if one:
        return [i for i in heard if article_of(lines[i].node) == one and i not in menus]
    if not core:
        return []
    top, first, last, size = core.section, core.first, core.last, core.size
    outer, rising = top, [s for s in found if s.height >= RISE * core.height]
    while outer > 0 and nodes[outer].tag not in ("main", "body"):
        outer = _section(nodes, nodes[outer].parent)
        high = [s for s in rising if _inside(nodes, s.section, outer)]
        if (more := sum(s.size for s in high)) >= (1 + BESIDE) * size:
            top, first, last, size = outer, min(s.first for s in high), max(s.last for s in high), more
    before = [i for i in heard if i < first and nodes[lines[i].node].tag == "h1"]
    if before and sum(lines[i].plain for i in heard if before[-1] < i < first) <= BYLINE and _inside(nodes, top, sections[before[-1]]):
        first = before[-1]
    return [i for i in heard if first <= i <= last and i not in menus]


def main_text(page: str) -> str:
    lines, nodes = lines_of(page)
    return "\n\n".join(lines[i].text for i in kept_lines(lines, nodes))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the column html, with text and n_chars (code points, long)."""
    own = pages.select(*(c for c in pages.columns if c not in (html, "text", "n_chars")), F.coalesce(html, F.lit("")).alias("__html"))
    keep = own.columns[:-1]
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, pieces in chunks(batch, "__html"):
                texts = [main_text(x.decode("utf-8", "replace")) for x in pieces]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return own.mapInArrow(run, schema)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
