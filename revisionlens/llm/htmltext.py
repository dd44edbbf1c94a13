"""Main text of web pages: the maximum-scoring run of words and tags.

A page becomes a sequence of events, its tags and its text pieces.  Words score
above zero and tags below; the weights are log-odds counted on labelled pages,
those that mark their article themselves (``<article>`` or ``<main>``).  One
linear scan finds the run with the highest sum.  The run is then widened to the
element that holds it (the enclosing article with its sibling articles, or the main
element, if there is one, so short paragraphs at its ends aren't lost), and its
blocks are the text.

Elements that are never content are left out by name (scripts, styles, menus,
forms, asides ...) or where a class, id or role says nothing else than that (adverts,
sidebars, notices, comments ...: ``ad``, ``related-posts``, ``cookie-notice-box``).
A name that holds other words too (``related-note``) only turns the score of its
words below zero, and nothing inside an article or around most of the page's words.
A form, dialog or object stays if it holds the
article or main element or, on pages without one, most of the page's words.  Only one page is in hand at a time; every
page is extracted whole, in time and memory linear in its tags and words.  At most ``SAMPLE_PAGES`` labelled pages (those of the
smallest id hashes) fit the weights; one weight a tag name of a fixed list is
all that reaches the driver.

Rules for text: character references are decoded, white space inside a block
is one space, ``<br>`` is white space, blocks without words are left out, and
blocks are joined by one line feed.

Nulls and odd input: a null or empty page, or one without words, has an empty
text; unclosed tags and comments, stray ends and lone ``<`` are read as browsers
do; repeated rows are extracted each; other columns are ignored; an empty table
gives an empty result (weights then are the defaults).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare

SAMPLE_PAGES = 2000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt".split())
LISTS = frozenset("ul ol dl table".split())
NEVER = frozenset("head nav footer aside form button select option optgroup datalist dialog menu script style noscript template textarea title svg math iframe object input".split())
WRAPPERS = frozenset("form dialog object".split())          # of NEVER, but some pages stand whole in one
NAMES = sorted(BLOCK | VOID | RAW | WRAPPERS | frozenset("a abbr b big cite code em font i ins del kbd label mark q s small span strike strong sub sup time tt u var button select option audio video".split()))
# Words of class, id and role that mark what isn't content.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login search
share sharing social related recommended recommendations comment comments reply replies respond disqus discussion footer masthead toolbar widget
pagination pager copyright alert toast skip complementary contentinfo form""".split())
MARKS_OUTSIDE = frozenset(["header"])          # of the page; inside an article they are its own
# Words beside a mark that don't change what it says ("related-posts", "cookie-notice-box").
BESIDE = frozenset("""area articles aside bar block blog body bottom box btn button buttons card cards center col column container content cta desktop
feed footer form global google header icons inline inner item items left link links list main middle mobile module outer page panel post posts primary
reader readers right row secondary section site slot stories sticky story text thread title tools top unit user users wp wrap wrapper""".split())
NEGATIONS = frozenset("with without has no".split())          # "content-with-sidebar" isn't a sidebar

_EVENT = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_MARK_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Page:
    """Elements (name, parent, marks, nearest article and main) and events of a page.

    Elements are numbered in the order of their start tags, so an element's
    descendants are the numbers after it up to ``last()[element]``.
    ``events``: (element, kind, value); kind 0 is text, 1 a start tag, 2 an end tag.
    """

    def __init__(self, source: str):
        self.name, self.parent, self.off, self.weak, self.holds = ["#root"], [-1], [False], [False], [False]
        self.article, self.main = [-1], [-1]       # the nearest one that holds the element or is it
        self.events: list[tuple[int, int, str]] = []
        self.marked = False                        # whether there is an article or main element
        self.stack, self.blocks, self.open = [0], [], Counter()     # open elements, places of blocks among them, open names
        at, n = 0, len(source)
        while at < n:
            m = _EVENT.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if close:
                if self.open[name]:
                    while self._pop() != name:
                        pass
                self.events.append((self.stack[-1], 2, name))
                continue
            if name in BLOCK:
                self._implied_end(name)
            e = self._start(name, self.stack[-1], attrs)
            self.events.append((e, 1, name))
            if name in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = n if end is None else (source.find(">", end.start()) + 1 or n)
            elif name not in VOID:
                if name in BLOCK:
                    self.blocks.append(len(self.stack))
                self.stack.append(e)
                self.open[name] += 1

    def _text(self, piece: str) -> None:
        self.events.append((self.stack[-1], 0, piece))

    def _pop(self) -> str:
        name = self.name[self.stack.pop()]
        self.open[name] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        return name

    def _implied_end(self, name: str) -> None:
        """A block ends an open paragraph, a list item an open item of its list, and so on."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(name, ()) + ("p",)
        if self.blocks and self.name[self.stack[self.blocks[-1]]] in ends:
            k = self.blocks[-1]
            while len(self.stack) > k:
                self._pop()

    def _start(self, name: str, parent: int, attrs: str) -> int:
        off, weak = name in NEVER and name not in WRAPPERS or bool(attrs and _HIDDEN.search(attrs)), False
        inside = self.article[parent] >= 0 or self.main[parent] >= 0
        if not off and attrs and name not in ("html", "body", "main"):
            for m in _MARK_ATTR.finditer(attrs):
                label = m[1].lower() == "aria-label"                    # a sentence, not names
                for one in [m[2] or m[3] or m[4] or ""] if label else (m[2] or m[3] or m[4] or "").split():
                    words = {w.lower() for w in _PARTS.findall(one)} - ({name} & WRAPPERS)          # id="form1" says no more than the name
                    marks = words & MARKS | (frozenset() if inside else words & MARKS_OUTSIDE)
                    if marks and not words & NEGATIONS:
                        off = off or all(w in BESIDE or len(w) == 1 for w in words - marks)
                        weak = weak or not inside
        off = off or name == "header" and not inside
        e = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.off.append(off)
        self.weak.append(weak)
        self.holds.append(False)
        self.article.append(e if name == "article" else self.article[parent])
        self.main.append(e if name == "main" else self.main[parent])
        if name in ("article", "main") and not off:
            self.marked = True
            while parent > 0 and not self.holds[parent]:
                self.holds[parent] = True
                parent = self.parent[parent]
        return e

    def last(self) -> list[int]:
        """Per element its last descendant (itself if it has none)."""
        out = list(range(len(self.name)))
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] = max(out[self.parent[e]], out[e])
        return out

    def doubtful(self) -> list[bool]:
        """Per element: its words score below zero, for a name at it or around it (not around the article or most of the page)."""
        if not any(self.weak):
            return [False] * len(self.name)
        n = self._words()
        out = [False]
        for e in range(1, len(self.name)):
            out.append(self.name[e] not in ("article", "main") and (out[self.parent[e]] or self.weak[e] and not self.holds[e] and 2 * n[e] <= n[0]))
        return out

    def dropped(self) -> list[bool]:
        """Per element: it or one around it is never content (an element that holds the article is)."""
        out: list[bool] = []
        most = self._most() if not self.marked else frozenset()
        for e, name in enumerate(self.name):
            up = self.parent[e] >= 0 and out[self.parent[e]]
            never = name in NEVER and not (name in WRAPPERS and (self.holds[e] or e in most))
            out.append(up or never or self.off[e] and not self.holds[e])
        return out

    def _most(self) -> frozenset[int]:
        """Forms, dialogs and objects that hold more than half of the page's words."""
        if WRAPPERS.isdisjoint(self.name):
            return frozenset()
        n = self._words()
        return frozenset(e for e, name in enumerate(self.name) if name in WRAPPERS and 2 * n[e] > n[0])

    def _words(self) -> list[int]:
        """Words inside each element."""
        n = [0] * len(self.name)
        for e, kind, value in self.events:
            if kind == 0:
                n[e] += _count_words(value)
        for e in range(len(n) - 1, 0, -1):                 # a parent comes before its children
            n[self.parent[e]] += n[e]
        return n


def _count_words(piece: str) -> int:
    return len(piece.split())


def labelled_counts(page: Page) -> dict[str, list[int]] | None:
    """Of a page that marks its article: per token how often it is inside and outside; else None."""
    out: dict[str, list[int]] = {}
    any_inside = False
    dropped = page.dropped()
    for e, kind, value in page.events:
        inside = not dropped[e] and (page.article[e] >= 0 or page.main[e] >= 0)
        any_inside |= inside
        token, n = ("#word", _count_words(value)) if kind == 0 else (value if value in _KNOWN else "#other", 1)
        out.setdefault(token, [0, 0])[0 if inside else 1] += n
    return out if any_inside else None


_KNOWN = frozenset(NAMES)
DEFAULT_WEIGHTS = {"#word": 1.0, "#other": -1.0, "p": -0.5, "br": -0.2}


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Words above zero, tags below: smoothed log-odds of being inside, shifted so that each keeps its side."""
    if not counts:
        return dict(DEFAULT_WEIGHTS)
    inside, outside = (sum(c[k] for c in counts.values()) for k in (0, 1))
    odds = {t: math.log((c[0] + 1) / (inside + 1)) - math.log((c[1] + 1) / (outside + 1)) for t, c in counts.items()}
    return {t: max(0.25, min(v, 2.0)) if t == "#word" else max(-6.0, min(v - 1.0, -0.25)) for t, v in odds.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """[first, last] of the highest-scoring run; (0, -1) if no score is above zero."""
    best, first, last = 0.0, 0, -1
    total, start = 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, first, last = total, start, k
    return first, last


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The page's main text: its blocks joined by line feeds."""
    if not source:
        return ""
    page = Page(source)
    dropped = page.dropped()
    if not any(kind == 0 and not dropped[e] and value.strip() for e, kind, value in page.events):
        page.off = [name in NEVER and name not in WRAPPERS for name in page.name]       # all is marked: only names count then
        dropped = page.dropped()
    word, other = weights.get("#word", 1.0), weights.get("#other", -1.0)
    doubtful = page.doubtful()

    def score(e: int, kind: int, value: str) -> float:
        if kind:
            return weights.get(value, other)
        return 0.0 if dropped[e] else (-word if doubtful[e] else word) * _count_words(value)

    first, last = best_run([score(*event) for event in page.events])
    if last < first:
        doubtful = [False] * len(doubtful)                 # nothing else on the page
        first, last = best_run([score(*event) for event in page.events])
    if last < first:
        return ""
    run = [e for e, kind, value in page.events[first:last + 1] if kind == 0 and not dropped[e] and value.strip()]
    ends = page.last()
    holder = _common(page, ends, run)
    while page.name[holder] not in BLOCK and holder > 0 or page.name[holder] in PROSE:
        holder = page.parent[holder]
    whole, inner = page.article[holder] >= 0 or page.main[holder] >= 0, [False] * len(page.name)
    chosen = {page.article[holder] if page.article[holder] >= 0 else page.main[holder]} if whole else {page.article[e] for e in run} - {-1}
    beside = {page.parent[c] for c in chosen if page.name[c] == "article"}
    prose = [False] * len(page.name)                       # in a paragraph or heading directly in the holder, or in a list, unless that is the whole page
    for e in range(1, len(page.name)):
        up = page.parent[e]
        inner[e] = inner[up] or e in chosen or page.name[e] == "article" and up in beside
        prose[e] = prose[up] or up == holder and (page.name[e] in PROSE or page.name[e] in LISTS and page.name[holder] not in ("#root", "html", "body")) and not doubtful[e]
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            blocks.append(text)
        piece.clear()

    for k, (e, kind, value) in enumerate(page.events):
        if kind:
            if value in BLOCK:
                flush()
            elif value == "br":
                piece.append(" ")
        elif not dropped[e] and (inner[e] or not whole and (first <= k <= last or prose[e])):
            piece.append(value)
    flush()
    return "\n".join(blocks)


def _common(page: Page, ends: list[int], elements: list[int]) -> int:
    """The lowest element that holds all of these."""
    holder, high = min(elements), max(elements)
    while ends[holder] < high:
        holder = page.parent[holder]
    return holder


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[str, list[int]] = {}
        for source in batch.column(0):
            for token, (a, b) in (labelled_counts(Page(source.as_py() or "")) or {}).items():
                c = total.setdefault(token, [0, 0])
                c[0] += a
                c[1] += b
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([c[0] for c in total.values()], pa.int64()), pa.array([c[1] for c in total.values()], pa.int64())], names=["token", "inside", "outside"])


def fitted_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``sample_pages`` pages that mark their article (a tag name of the fixed list each)."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[ >]")).select("page_id", "html")
    cut = marked.select("page_id").orderBy(F.xxhash64("page_id")).limit(sample_pages).agg(F.max(F.xxhash64("page_id"))).first()[0]
    if cut is None:
        return dict(DEFAULT_WEIGHTS)
    rows = marked.filter(F.xxhash64("page_id") <= F.lit(cut)).select("html").mapInArrow(_label, "token string, inside long, outside long")
    return weights_of({r[0]: (r[1], r[2]) for r in rows.groupBy("token").agg(F.sum("inside"), F.sum("outside")).collect()})


def extract_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    weights = fitted_weights(pages, sample_pages)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
