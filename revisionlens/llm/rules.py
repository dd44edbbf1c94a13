"""Quality rules as a short-circuit cascade.

One pass lays whole texts out in numpy (see ``textbatch``) and computes the base
statistics of every document.  The other rules form a cascade: a rule is only
evaluated on documents that no earlier rule has rejected, and computes for those alone the
statistics that aren't there yet.  The order comes from a sample of
documents (``SAMPLE_ROWS``, those of the smallest id hashes): each rule's cost and rejections
are counted there on all sampled documents, and rules run by rejections per
cost, highest first.  Cost is counted work, one for each byte or item that a statistic passes over, not
time: the same documents give the same order in every run.  A verdict is the conjunction of all rules, so it doesn't
depend on the order; ``rejected_by`` is the first rule of that order that fails.

Nulls and odd input: a null or empty text has no words and fails the base rule;
a null ``doc_id`` stays null; repeated rows are judged each; other columns are ignored; an
empty table gives an empty result (and the rules in the order given).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare
from revisionlens.llm.textbatch import SPACE, Texts, chunks, combined

SAMPLE_ROWS = 2000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"[#*$%&|<>]"[1:-1]


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(values)] = 1
    return out


_SYMBOL = _class(SYMBOLS)
_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(192, 256)]))     # ASCII letters and first bytes of longer sequences
_CODE_POINT = np.ones(256, np.int64)
_CODE_POINT[128:192] = 0


class Stats:
    """Statistics of a batch of texts, each computed when first asked for; ``work`` counts the bytes and items passed over."""

    def __init__(self, texts: Texts):
        self.t = texts
        self.work = 0
        self.known: dict[str, np.ndarray] = {}
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._prefix: np.ndarray | None = None

    def _at(self, name: str, values: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.known:
            self.known[name] = values()
        return self.known[name]

    def take(self, rows: np.ndarray) -> Stats:
        """These rows alone, with the statistics that are known."""
        part = Stats(_rows(self.t, rows))
        part.known = {name: values[rows] for name, values in self.known.items()}
        return part

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = self.t.words()
            self.work += 2 * len(self.t.buf)
        return self._words

    @property
    def n_words(self) -> np.ndarray:
        return self._at("n_words", lambda: np.diff(self.words()[2]))

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = self.t.prefix(False)
            self.work += 2 * len(self.t.buf)
        return self._prefix

    def count(self, table: np.ndarray) -> np.ndarray:
        """Per text the sum of a byte table over its bytes."""
        self.work += len(self.t.buf)
        sums = np.concatenate([[0], np.cumsum(table[self.t.buf])])
        return sums[self.t.end] - sums[self.t.start]

    def word_chars(self) -> np.ndarray:
        return self._at("word_chars", lambda: self.count(_CODE_POINT * ~SPACE))

    def n_symbols(self) -> np.ndarray:
        return self._at("n_symbols", lambda: self.count(_SYMBOL))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text the lines with a word, and how many of them repeat an earlier one."""
        if "n_lines" not in self.known:
            self.known["n_lines"], self.known["n_dup_lines"] = self._lines()
        return self.known["n_lines"], self.known["n_dup_lines"]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.t
        ws = self.words()[0]
        end = np.flatnonzero(t.buf == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        worded = np.searchsorted(ws, end) > np.searchsorted(ws, start)
        row = np.searchsorted(t.end, end[worded])
        h = t.span_hash(self.prefix(), start[worded], end[worded])
        self.work += len(t.buf) + 2 * len(end)
        order = np.lexsort((h, row))
        again = (np.diff(h[order]) == 0) & (np.diff(row[order]) == 0) if len(h) else np.zeros(0, bool)
        return np.bincount(row, minlength=t.rows), np.bincount(row[order][1:][again], minlength=t.rows) if len(h) else np.zeros(t.rows, np.int64)

    def n_repeat_words(self) -> np.ndarray:
        """Words inside three-word windows that the text holds twice or more."""
        t = self.t
        ws, we, first = self.words()
        h = t.span_hash(self.prefix(), ws, we)
        out = np.zeros(t.rows, np.int64)
        if len(h) < 3:
            return out
        grams = combined([h[:-2], h[1:-1], h[2:]])
        for i in np.flatnonzero(self.n_words > 3).tolist():
            a, b = int(first[i]), int(first[i + 1])
            g = grams[a:b - 2]
            order = np.argsort(g, kind="stable")
            same = np.diff(g[order]) == 0
            if same.any():
                twice = np.zeros(b - a, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                twice[1:] |= twice[:-1].copy() | np.concatenate([[False], twice[:-2]])
                out[i] = twice.sum()
        return out


@dataclass(frozen=True)
class Rule:
    """``fails``: of a batch's statistics, which texts it rejects."""

    name: str
    fails: Callable[[Stats], np.ndarray]


#: The cascade's rules, from loose public heuristics: only clear junk is rejected.
RULES = (
    Rule("symbols_per_word", lambda s: 2 * s.n_symbols() > s.n_words),
    Rule("mean_word_length", lambda s: (s.word_chars() < 2 * s.n_words) | (s.word_chars() > 25 * s.n_words)),
    Rule("repeated_lines", lambda s: (lambda n, again: 2 * again > n)(*s.lines())),
    Rule("upper_case", lambda s: 2 * s.count(_UPPER) > s.count(_LETTER)),
    Rule("digits", lambda s: 2 * s.count(_DIGIT) > s.word_chars()),
    Rule("letters", lambda s: 10 * s.count(_CODE_POINT * _LETTER) < 3 * s.word_chars()),
)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in chunks(batch.column(0)):
            for k, rule in enumerate(RULES):
                stats = Stats(texts)
                rejected = int(rule.fails(stats).sum())
                yield pa.record_batch([pa.array([k]), pa.array([stats.work]), pa.array([rejected])], names=["rule", "work", "rejected"])


def rule_order(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of :data:`RULES` by rejections per counted work on the sample."""
    ids = documents.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).agg(F.max(F.xxhash64("doc_id"))).first()[0]
    if ids is None:
        return [r.name for r in RULES]
    sample = documents.filter(F.xxhash64("doc_id") <= F.lit(ids)).select("text")
    seen = sample.mapInArrow(_measured, "rule long, work long, rejected long").groupBy("rule").agg(F.sum("work"), F.sum("rejected")).collect()
    rate = {r[0]: r[2] / max(r[1], 1) for r in seen}
    return [RULES[k].name for k in sorted(range(len(RULES)), key=lambda k: (-rate.get(k, 0.0), k))]


def cascade(texts: Texts | Stats, alive: np.ndarray, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(still alive, index of the rejecting rule or -1): each rule sees only texts that are alive when it runs."""
    alive, by = alive.copy(), np.full(len(alive), -1, np.int64)
    named = {r.name: k for k, r in enumerate(RULES)}
    part, rows = (texts if isinstance(texts, Stats) else Stats(texts)), np.arange(len(alive))
    for name in order:
        left = np.flatnonzero(alive[rows])
        if not len(left):
            break
        if len(left) < len(rows):
            part, rows = part.take(left), rows[left]
        bad = rows[RULES[named[name]].fails(part).astype(bool)]
        alive[bad] = False
        by[bad] = named[name]
    return alive, by


def _rows(texts: Texts, rows: np.ndarray) -> Texts:
    size = (texts.end - texts.start)[rows]
    inside = np.zeros(len(texts.buf) + 1, np.int8)
    np.add.at(inside, texts.start[rows], 1)
    np.add.at(inside, texts.end[rows], -1)
    return Texts(texts.buf[np.cumsum(inside[:-1]).astype(bool)], np.concatenate([[0], np.cumsum(size)]))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def quality_rules(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the base statistics, ``base_failed``, ``kept`` and ``rejected_by`` (a rule's name, ``base`` or null)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = rule_order(docs, sample_rows)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunks(batch.column(1)):
                s = Stats(texts)
                columns = [s.n_words, s.word_chars(), s.n_symbols(), s.lines()[1]]
                repeat = s.n_repeat_words()
                base = (s.n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * s.n_words)
                kept, by = cascade(s, ~base, order)
                names = [RULES[k].name if k >= 0 else "base" if b else None for k, b in zip(by.tolist(), base.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (*columns, repeat)),
                                       pa.array(base), pa.array(kept), pa.array(names, pa.string())],
                                      names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return docs.mapInArrow(judged, OUT)
