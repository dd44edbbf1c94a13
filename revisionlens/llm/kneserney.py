"""Quality classifier: interpolated modified Kneser-Ney over UTF-8 bytes, trained on trusted text.

The alphabet is the 256 byte values, so every character of every script counts as
what it is (one of three bytes fills three of a five-gram's places).
Trusted documents are those labelled of quality (and not toxic).  Their byte
five-grams are counted in each task and summed by gram; the lower orders'
continuation counts, discounts, context sums and probabilities are grouped sums
and joins sharded by gram.  A document's perplexity is that of its whole text.

Scoring: if the model has at most ``MODEL_ENTRIES`` entries (counted; 16 bytes
each), every task gets it whole.  Beyond it the distinct five-grams of the corpus
are joined with the model's shards order by order, and go back to their documents
by a second join.  Both ways give the same score.

A document is rejected if its score is above its language's threshold: the
``QUANTILE`` of trusted documents' scores in that language, and ``SLACK`` (in nats
a character) more.  One in ``HELD_OUT`` trusted documents isn't trained on and sets the thresholds.  The score is the mean negative log-probability of a character, drawn
towards the language's mean as if the text had ``PRIOR_CHARS`` more characters, so
that a few odd characters don't reject a very short text.  Quantiles are read
from histograms with bins of a thousandth, which are exact sums and the same on every run.

Nulls and odd input: a null or empty text has no perplexity and is kept (nothing
speaks against it); a null language is a language of its own; one without trusted documents takes the threshold of all; without trusted
documents nothing is rejected; repeated rows are judged each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisionlens.llm.common import checked_broadcast, frees, prepare, written

ORDER = 5
BITS = 8
MODEL_ENTRIES = 2_000_000
QUANTILE, SLACK, PRIOR_CHARS = 0.995, 0.15, 100
HELD_OUT = 10
CHUNK_CHARS = 1 << 18
TASK_GRAMS = 1_000_000       # distinct five-grams that a task holds before it hands on what it has
START = b"\xff"              # not a byte of UTF-8


def five_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The five-grams that end at each byte of the texts, and each text's first place among them.

    Each text begins with four start symbols, which are context only.
    """
    raw = [t.encode() for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    c = np.frombuffer((START * (ORDER - 1)).join([b"", *raw]), np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    if not first[-1]:
        return np.zeros(0, np.int64), first
    g = c[:len(c) - ORDER + 1].copy()
    for k in range(1, ORDER):
        g = (g << BITS) | c[k:len(c) - ORDER + 1 + k]
    # grams whose last byte is a text's: after its start symbols
    ends = np.repeat(np.arange(len(texts)) * (ORDER - 1), size) + np.arange(first[-1])
    return g[ends], first


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about CHUNK_CHARS characters; null is empty."""
    lo, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield lo, part
            lo, part, size = i + 1, [], 0


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    return g[first], np.add.reduceat(n, first) if len(g) else n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        g, n = _summed(np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have]))
        for k in range(0, len(g), 100_000):
            yield pa.record_batch([pa.array(g[k:k + 100_000]), pa.array(n[k:k + 100_000])], names=["gram", "n"])

    for batch in batches:
        for _, texts in _pieces(batch.column(0)):
            have.append(np.unique(five_grams(texts)[0], return_counts=True))
            if sum(len(x[0]) for x in have) > TASK_GRAMS:
                have = [_summed(np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have]))]
                if len(have[0][0]) > TASK_GRAMS // 2:
                    yield from out()
                    have = []
    if have:
        yield from out()


def train(texts: DataFrame) -> DataFrame:
    """The model over the one column of ``texts``: ``kind, key, value``.

    kind k > 0: the log-probability of a k-gram's last byte; kind -k: the log of what the context
    of a k-gram leaves to the lower order.
    """
    mask = lambda k: (1 << (BITS * k)) - 1
    tables = [written(texts.mapInArrow(frees(_counted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c")), "kn-5")]
    for k in range(ORDER - 1, 0, -1):       # continuation counts
        tables.insert(0, written(tables[0].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("c")), f"kn-{k}"))
    lower, model = None, None
    for k, grams in enumerate(tables, 1):
        n = {r[0]: r[1] for r in grams.filter("c <= 4").groupBy("c").agg(F.count("*")).collect()}      # four numbers
        n1, n2, n3, n4 = (max(1, n.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        off = F.least(off, F.col("c") * 0.95)
        grams = grams.select("gram", F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(mask(k - 1)).alias("rest"), "c", off.alias("off"))
        contexts = grams.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("left"))
        grams = grams.join(contexts, "context")
        below = F.lit(1.0 / (1 << BITS))
        if lower is not None:
            grams, below = grams.join(lower, "rest"), F.exp("below")
        p = F.log((F.col("c") - F.col("off")) / F.col("total") + F.col("left") / F.col("total") * below)
        grams = written(grams.select("gram", p.alias("value")), f"kn-p{k}")
        contexts = written(contexts.select(F.col("context").alias("gram"), F.log(F.col("left") / F.col("total")).alias("value")), f"kn-c{k}")
        lower = grams.select(F.col("gram").alias("rest"), F.col("value").alias("below"))
        for kind, t in ((k, grams), (-k, contexts)):
            t = t.select(F.lit(kind).alias("kind"), F.col("gram").alias("key"), "value")
            model = t if model is None else model.unionByName(t)
    return model


class Lookup:
    """A table of 64-bit keys in arrays: hashed buckets, answered for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        place = self._place(keys)
        order = np.argsort(place, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], 0.0)
        self.start = np.searchsorted(place[order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.start).max(initial=0))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether it is there) for each key."""
        place = self._place(keys)
        at, end = self.start[place], self.start[place + 1]
        value, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        todo = np.flatnonzero(at < end)
        for step in range(self.deep):
            hit = self.keys[at[todo] + step] == keys[todo]
            value[todo[hit]] = self.values[at[todo[hit]] + step]
            there[todo[hit]] = True
            todo = todo[~hit]
            todo = todo[at[todo] + step + 1 < end[todo]]
            if not len(todo):
                break
        return value, there


def log_probabilities(grams: np.ndarray, model: dict[int, Lookup]) -> np.ndarray:
    """Of each five-gram's last byte: the longest known gram's, less what each longer context leaves."""
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        g = grams[todo] & ((1 << (BITS * k)) - 1)
        value, there = model[k].find(g)
        out[todo[there]] += value[there]
        todo, g = todo[~there], g[~there]
        if not len(todo):
            return out
        out[todo] += model[-k].find(g >> BITS)[0]
    out[todo] -= BITS * np.log(2)
    return out


def _whole(docs: DataFrame, model: DataFrame) -> DataFrame:
    rows = model.toArrow()                                     # at most MODEL_ENTRIES, counted before
    kind, key, value = (rows.column(i).to_numpy() for i in range(3))
    shared = docs.sparkSession.sparkContext.broadcast({int(k): (key[kind == k], value[kind == k]) for k in np.unique(kind)})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Lookup(*shared.value.get(k, (np.zeros(0, np.int64), np.zeros(0)))) for k in [*range(1, ORDER + 1), *range(-ORDER, 0)]}
        for batch in batches:
            for lo, texts in _pieces(batch.column(2)):
                grams, first = five_grams(texts)
                sums = np.concatenate([[0.0], np.cumsum(log_probabilities(grams, tables))])
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums[first[:-1]] - sums[first[1:]]),
                                       batch.column(3).slice(lo, len(texts))], names=["doc_id", "lang", "n_chars", "nll", "row_id"])

    return docs.mapInArrow(frees(scored), "doc_id long, lang string, n_chars long, nll double, row_id long")


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            g, n = np.unique(five_grams([text.as_py() or ""])[0], return_counts=True)
            yield pa.record_batch([pa.array([batch.column(0)[i].as_py()] * len(g), pa.int64()), pa.array(g), pa.array(n)], names=["row", "gram", "n"])


def _sharded(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same scores by joins on the gram: nothing is held whole anywhere."""
    docs = written(docs.select("doc_id", "lang", "text", "row_id", F.monotonically_increasing_id().alias("row")), "kn-docs")
    held = written(docs.select("row", "text").mapInArrow(frees(_grams_of), "row long, gram long, n long"), "kn-grams")
    model = written(model, "kn-model")
    open_ = held.select("gram").distinct().withColumn("sum", F.lit(0.0))
    done = None
    for k in range(ORDER, 0, -1):
        mask = (1 << (BITS * k)) - 1
        own = model.filter(F.col("kind") == k).select(F.col("key").alias("own"), F.col("value").alias("p"))
        left = model.filter(F.col("kind") == -k).select(F.col("key").alias("context"), F.col("value").alias("w"))
        t = open_.join(own, F.col("gram").bitwiseAND(mask) == F.col("own"), "left").join(left, F.shiftright(F.col("gram").bitwiseAND(mask), BITS) == F.col("context"), "left")
        t = written(t.select("gram", "p", F.when(F.col("p").isNotNull(), F.col("sum") + F.col("p")).otherwise(F.col("sum") + F.coalesce("w", F.lit(0.0))).alias("sum")), f"kn-open{k}")
        found = t.filter("p is not null").select("gram", "sum")
        done = found if done is None else done.unionByName(found)
        open_ = t.filter("p is null").select("gram", "sum")
    done = done.unionByName(open_.select("gram", (F.col("sum") - BITS * float(np.log(2))).alias("sum")))
    sums = held.join(done, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("sum")).alias("s"))
    return docs.join(sums, "row", "left").select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), (-F.coalesce("s", F.lit(0.0))).alias("nll"), "row_id")


def score(docs: DataFrame, model: DataFrame, model_entries: int = MODEL_ENTRIES) -> DataFrame:
    """``doc_id, lang, n_chars, nll, row_id`` of ``doc_id, lang, text, row_id``."""
    return _whole(docs, model) if model.count() <= model_entries else _sharded(docs, model)


def quality_scores(documents: DataFrame, labels: DataFrame, model_entries: int = MODEL_ENTRIES, row_id: str | None = None) -> DataFrame:
    """Per document ``doc_id, lang, n_chars, perplexity, score, threshold, kept``, and ``row_id`` if its column (long) is named."""
    prepare(documents.sparkSession)
    row = F.lit(None) if row_id is None else F.col(row_id)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", row.cast("long").alias("row_id"))
    trusted = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = written(trusted.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")), "trusted")
    n = trusted.count()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    near, fit = (checked_broadcast(x, n) for x in (trusted.filter(held), trusted.filter(~held)))
    if not near.head(1):                # too few to hold any out
        near = fit
    model = train(docs.join(fit, "doc_id", "left_semi").select("text"))
    scores = written(score(docs, model, model_entries), "kn-scores")

    own = scores.join(near, "doc_id", "left_semi").filter("n_chars > 0")
    means = own.groupBy("lang").agg((F.sum("nll") / F.sum("n_chars")).alias("mean"))
    all_mean = own.agg((F.sum("nll") / F.sum("n_chars")).alias("all_mean"))
    drawn = lambda mean: (F.col("nll") + PRIOR_CHARS * mean) / (F.col("n_chars") + PRIOR_CHARS)
    bins = own.join(means.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).groupBy("lang", F.floor(drawn(F.col("mean")) * 1000).alias("bin")).agg(F.count("*").alias("n"))
    bins = written(bins, "kn-bins")

    def quantile(*by: str) -> DataFrame:
        b = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        part = W.partitionBy(*by)
        b = b.withColumn("upto", F.sum("n").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(part))
        return b.filter(F.col("upto") >= QUANTILE * F.col("all")).groupBy(*by).agg(((F.min("bin") + 1) / 1000 + SLACK).alias("threshold"))

    limits = means.join(quantile("lang").withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).select(F.col("lang").alias("of"), "mean", "threshold")
    everything = all_mean.join(quantile().withColumnRenamed("threshold", "all_threshold"), F.lit(True), "left")      # one row each
    out = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(everything), F.lit(True), "left")
    limit, value = F.coalesce("threshold", "all_threshold"), drawn(F.coalesce("mean", "all_mean"))
    some = F.col("n_chars") > 0
    return out.select("doc_id", "lang", "n_chars", F.when(some, F.exp(F.col("nll") / F.col("n_chars"))).alias("perplexity"), F.when(some, value).alias("score"), limit.alias("threshold"),
                      F.coalesce(~some | (value <= limit), F.lit(True)).alias("kept"), *([] if row_id is None else ["row_id"]))
