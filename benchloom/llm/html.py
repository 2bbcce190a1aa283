"""Main text of pages: the maximum-scoring contiguous run of a page's words (positive) and tags (negative).

Some elements are boilerplate by what they say of themselves: their tag (nav, aside, script) or a word of their class, id or
role. Their texts score nothing, cut nothing and are not part of the result. A page marks its article if at least a quarter of
its other words lie under elements that speak for content (article, main, class "content"): then these words score, other
words score nothing and are left out, and the run goes from the first of them to the last. On other pages every word
scores: less or more by the names of the elements above it, below zero in blocks of links alone (but headings). Tags of blocks
cost, once between two texts however many they are, so that one-word items still add to a run. One linear scan finds the best
run; all of it that is not boilerplate is the result.

Weights come from labelled pages, those whose markup names their article (article, main or role main), at most ``sample`` of
them by smallest hash: on how many pages a name of class, id or role stands within or above an article, and on how many
outside of it. Plain tags say nothing but for those that are listed here: that labelled pages have no list in an article says
nothing of lists. Names that are listed, too, start from counts that stand for that; labelled pages can outweigh them.

A name of several words (``site-footer``) speaks as its last word does, if the words before are of these lists, too: ``legal-news``
and ``search-results-explained`` are names of their own, of which labelled pages may say something.

Defined results: a null or empty page, and one without content, has an empty text. Broken markup is read on: unclosed
elements end where their parents end, an unclosed script or comment takes the rest, as browsers do. Character references
are decoded, white space within a block becomes one space; blocks (and line breaks) are joined by a line end. Other
columns stay, a column named like the result is replaced; repeated rows are treated alike; an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from benchloom.llm.common import bound_batches, free_names

# Fixed names: elements of HTML by what they do, and words of attributes that pages use for their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "button", "option", "select", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
SCOPE = frozenset("table ul ol dl select menu".split())
SKIP_TAGS = frozenset("nav footer aside form head script style noscript template iframe button select textarea object dialog menu svg math title search canvas".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead banner footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay lightbox "
    "subscribe subscription newsletter signup login share sharing social socials related recommended recommendations trending popular teaser comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager toolbar topbar copyright legal disclaimer search form hidden skip contentinfo complementary dialog outbrain taboola".split())
#: Words that say where or how something stands, not what it is.
STRUCTURE = frozenset("area bar bars block body bottom box boxes btn button buttons col column container content first group holder icons inner item items last left link links list main module page panel placeholder post posts right row section site slot top unit wrap wrapper zone".split())
MAIN_WORDS = frozenset("article articlebody articletext content entry maincontent main post postbody postcontent story storybody".split())

_TOKEN = re.compile(r"<!--(?:>|->)?|<!\[CDATA\[|<(?:[!?][^>]*>?)|<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"['\">]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Characters of attributes up to which what they say is remembered.
CACHED = 1000
#: Pages of which a name must be known; what a listed name starts with, in pages inside and outside of articles.
SEEN, LISTED = 3, (0.5, 8.0)
#: Scores: a word; a word of a block of links; the first tag of a block after a text. How far names move a word's score.
WORD, LINK, TAG, LEAST, MOST = 0.6, -0.6, -0.35, -1.2, 0.6
#: The share of words under elements that speak for content from which on a page marks its article.
MARKED = 0.25


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes), ("close", tag, "") in page order; raw elements without content."""
    at, n = 0, len(page)
    search, last, ends = 0, page.rfind(">"), _Ends(page)
    while at < n:
        m = _TOKEN.search(page, search)
        if not m or m[2] and m.start() > last:
            yield "text", page[at:], ""
            return
        end = ends.after(m.end()) if m[2] else m.end()
        if end < 0:
            search = m.start() + 1
            continue
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = end
        if m[0].startswith("<!--"):
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
        elif m[0].startswith("<![CDATA["):
            end = page.find("]]>", at)
            at = n if end < 0 else end + 3
        elif m[2]:
            tag, attributes = m[2].lower(), page[m.end() : end - 1]
            if m[1]:
                yield "close", tag, ""
            else:
                yield "open", tag, attributes
                if tag in RAW and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = end.end() if end else n
                    yield "close", tag, ""
        search = at


class _Ends:
    """Where tags of a page end: after the first > outside of quotes. A quote met before by a tag without an end is not read again."""

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()
        self.at, self.stop = len(page) + 1, -1

    def after(self, at: int) -> int:
        """The end of the tag whose attributes start at ``at``; -1: it has none."""
        if not self.at <= at <= self.stop:
            m = _STOP.search(self.page, at)
            self.at, self.stop = at, m.start() if m else len(self.page)
        stop, path = self.stop, []
        while stop < len(self.page) and stop not in self.dead:
            if self.page[stop] == ">":
                return stop + 1
            path.append(stop)
            close = self.page.find(self.page[stop], stop + 1)
            m = _STOP.search(self.page, close + 1) if close >= 0 else None
            stop = m.start() if m else len(self.page)
        self.dead.update(path)
        return -1


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element says of itself: its tag, the words of its class, id and role, and hidden."""
    return (_names if len(attributes) <= CACHED else _names.__wrapped__)(tag, attributes)


def _said(words: list[str]) -> list[str]:
    """The names that the words of a compound stand for: itself, and its deciding word if the others are known, too."""
    joined = "".join(words)
    if len(words) < 2:
        return words
    telling = [w for w in words if w in SKIP_WORDS or w in MAIN_WORDS]
    if not telling or any(w not in STRUCTURE and w not in SKIP_WORDS and w not in MAIN_WORDS for w in words):
        return [joined]
    skip = [w for w in telling if w in SKIP_WORDS]
    last = next(w for w in reversed(words) if w in telling and (w not in STRUCTURE or not skip))
    return [joined, last]


@lru_cache(20_000)
def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = {f"<{tag}>": None}
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            for part in value.split():
                out |= dict.fromkeys(_said([w.lower() for w in _NAME.findall(part)]))
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value == "true":
            out["hidden"] = None
    return tuple(out)


def _listed(name: str) -> int:
    """-1: listed as boilerplate, 1: as content, 0: not listed."""
    if name[:1] == "<":
        return -1 if name[1:-1] in SKIP_TAGS else 1 if name[1:-1] in MAIN_TAGS else 0
    return -1 if name in SKIP_WORDS else 1 if name in MAIN_WORDS else 0


@dataclass
class Weights:
    """For names: pages on which they stand within or above an article, and outside of it."""

    counts: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._of: dict[tuple[str, str], tuple[int, float]] = {}

    def of(self, tag: str, attributes: str) -> tuple[int, float]:
        """What an element is (-1 boilerplate, 1 content, 0 neither), and log odds of its names that are not listed."""
        key = (tag, attributes)
        if (got := self._of.get(key)) is None:
            listed, odds = 0.0, 0.0
            for name in names(tag, attributes):
                inside, outside = self.counts.get(name, (0.0, 0.0))
                if (side := _listed(name)) and name[:1] == "<":
                    listed += 3.0 * side
                elif side:
                    a, b = LISTED if side < 0 else LISTED[::-1]
                    listed += log((inside + a) / (outside + b))
                elif name[:1] != "<" and inside + outside >= SEEN:
                    odds += log((inside + 1) / (outside + 1))
            got = (-1 if listed <= -1 else 1 if listed >= 1 else 0), odds
            if len(self._of) > 50_000:
                self._of.clear()
            if len(attributes) <= CACHED:
                self._of[key] = got
        return got


@dataclass(frozen=True)
class Under:
    """What the open elements say of a text below them all."""

    skipped: bool = False
    form: bool = False
    header: bool = False
    inside: bool = False
    odds: float = 0.0

    def then(self, tag: str, said: tuple[int, float]) -> "Under":
        if tag in ("html", "body"):
            return self
        side, odds = said
        skipped, form, header = self.skipped, self.form, self.header or tag == "header"
        if side < 0:
            if tag == "form":
                form = True  # an article below, which some pages wrap in a form, is content all the same
            else:
                skipped = True
        elif side > 0:
            return Under(skipped, form and tag not in MAIN_TAGS, header, True, self.odds + odds)
        return Under(skipped, form, header, self.inside, self.odds + odds)

    @property
    def boilerplate(self) -> bool:
        """A header is one outside of what speaks for content."""
        return self.skipped or self.form or self.header and not self.inside


@dataclass
class Element:
    tag: str
    attributes: str
    under: Under


def nodes(page: str, weights: Weights) -> Iterator[tuple[str, str, list[Element]]]:
    """Events with the open elements above them; a close event comes after the element it ends."""
    stack: list[Element] = []
    count: Counter = Counter()

    def cut(i: int) -> None:
        count.subtract(e.tag for e in stack[i:])
        del stack[i:]

    for kind, value, attributes in events(page):
        if kind == "text":
            yield "text", value, stack
        elif kind == "open":
            if value in ENDS_P and count["p"]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"))
            if value in CLOSES and any(count[t] for t in CLOSES[value]):
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in SCOPE or stack[i].tag in CLOSES[value])
                if stack[at].tag in CLOSES[value]:
                    cut(at)
            yield "open", value, stack
            if value not in VOID and not (attributes.endswith("/") and value in RAW):
                stack.append(Element(value, attributes, (stack[-1].under if stack else Under()).then(value, weights.of(value, attributes))))
                count[value] += 1
        else:
            if count[value]:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == value))
            yield "close", value, stack


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the largest positive sum (the first of equal ones); (0, 0): none is positive."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, at = run, (start, i + 1)
    return at


@dataclass
class Token:
    """A text or tag; ``out``: not part of any result."""

    kind: str
    value: str
    words: int = 0
    score: float = 0.0
    out: bool = False


def scored(page: str, weights: Weights) -> list[Token]:
    """The tokens of a page with their scores."""
    tokens: list[Token] = []
    unders: list[Under] = []
    links, block, heading = [0, 0], [], False

    def end_block() -> None:
        # A block of links alone: a menu or a list of other pages, but for headings.
        if links[0] and links[0] == links[1] and not heading:
            for t in block:
                t.score = LINK
        links[:] = [0, 0]
        block.clear()

    top = Under()
    for kind, value, stack in nodes(page, weights):
        under = stack[-1].under if stack else top
        token = Token(kind, value, len(value.split()) if kind == "text" else 0, out=under.boilerplate)
        tokens.append(token)
        unders.append(under)
        if kind != "text":
            if value in BLOCK:
                end_block()
                heading = kind == "open" and value in HEADINGS
        elif token.words and not token.out:
            links[0] += token.words
            links[1] += token.words if any(e.tag == "a" for e in stack[-4:]) else 0
            block.append(token)
    end_block()
    inside = sum(t.words for t, u in zip(tokens, unders) if u.inside and not t.out)
    marked = inside > 0 and inside >= MARKED * sum(t.words for t in tokens if not t.out)
    fresh = False
    for t, u in zip(tokens, unders):
        if t.kind != "text":
            if t.value in BLOCK and fresh and not marked:
                t.score, fresh = TAG, False
        elif marked:
            t.out = t.out or not u.inside
            t.score = 0.0 if t.out else WORD * t.words
        elif t.out:
            t.score = 0.0
        elif t.words:
            t.score = t.words * (t.score or WORD + min(MOST, max(LEAST, 0.5 * u.odds)))
            fresh = True
    return tokens


def text_of(tokens: list[Token]) -> str:
    """What tokens say: blocks, joined by line ends."""
    blocks, own = [], []
    for t in [*tokens, Token("open", "p")]:
        if t.kind == "text":
            if not t.out:
                own.append(t.value)
        elif t.value in BLOCK:
            if line := " ".join(entities.unescape("".join(own)).split()):
                blocks.append(line)
            own = []
    return "\n".join(blocks)


def extract(page: str, weights: Weights) -> str:
    """The main text of one page."""
    tokens = scored(page, weights) if page else []
    low, high = best_run([t.score for t in tokens])
    return text_of(tokens[low:high])


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = 1000) -> Weights:
    """Weights of at most ``sample`` pages that name their article."""
    named = pages.filter(F.col(f"`{html}`").rlike(r"(?i)<(?:article|main)[\s>]|role\s*=\s*[\"']?main")).select(F.col(f"`{html}`").alias("html"), F.xxhash64(f"`{page_id}`", f"`{html}`").alias("h"))
    # Hashes alone are ordered; html moves only for the rows up to the last chosen one.
    last = named.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = named.filter(F.col("h") <= F.lit(last).cast("bigint")).dropDuplicates(["h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sums = Weights(), {}
        for batch in batches:
            for page in batch.column(0):
                sides: dict[str, set[int]] = {}
                for kind, value, stack in nodes(page.as_py() or "", flat):
                    if kind == "text" and not value.isspace():
                        top = next((i for i, e in enumerate(stack) if e.tag in MAIN_TAGS or re.search(r"role\s*=\s*[\"']?main", e.attributes)), None)
                        # Within an article, but under a part of it that is boilerplate by its name: neither side.
                        if top is not None and any(flat.of(e.tag, e.attributes)[0] < 0 for e in stack[top:]):
                            continue
                        for e in stack:
                            for name in names(e.tag, e.attributes):
                                sides.setdefault(name, set()).add(top is None)
                for name, both in sides.items():
                    own = sums.setdefault(name, [0.0, 0.0])
                    # An element above an article holds other things, too: it counts as content alone.
                    own[0 if False in both else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.float64())], ["name", "inside", "outside"])

    counts = chosen.select("html").repartition(8).mapInArrow(count, "name string, inside double, outside double").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # Names of a bounded sample.
    return Weights({r.name: (r.inside, r.outside) for r in counts.filter(F.col("inside") + F.col("outside") >= SEEN).collect()})


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", out: str = "main_text", keep: list[str] | None = None, sample: int = 1000) -> DataFrame:
    """``pages`` (columns ``keep``, default all) with ``out``, the main text of each page."""
    kept = [c for c in (pages.columns if keep is None else keep) if c != out]
    (body,) = free_names([*kept, out], "html")
    bound_batches(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(fit(pages, page_id, html, sample).counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [extract(v.as_py() or "", own) for v in rows.column(body)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out])

    schema = StructType([*[pages.schema[c] for c in kept], StructField(out, StringType())])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias(body)).mapInArrow(run, schema)
