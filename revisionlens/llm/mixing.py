"""Mixing sources to target weights, in DataFrame functions only.

Targets share the words of all documents among the sources by weight; a target
stops at ``MAX_EPOCHS`` times its source's words and the excess is shared again
(the closed form of that: one level for all sources below their stop, found by
sorting the sources by stop per weight).  A source first gives its complete
epochs.  The rest of its target is filled by Efraimidis-Spirakis sampling: each
document has the key ``-ln(u) / weight`` with ``u`` from the md5 of its id, and
the documents of the smallest keys are taken until the prefix sum of their words
meets the rest (the document on the border is taken if half of it or more fits).

The prefix sum is in two steps, so that a source with a third of all rows is
never sorted in one task: keys fall into buckets in the keys' order (their
number grows with the source's rows), bucket totals are summed up in order, and
only the one bucket on the border of each source is sorted.

Nulls and odd input: a null text has no words; a null source is a source of its
own, the last; a null ``doc_id`` has the key of the empty string; repeated rows
are documents of their own (with equal keys, taken one after the other); a
source without words has the target 0; other columns are ignored by
:func:`mix_table` and kept by :func:`mixed`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)          # by the source's place in code point order, repeating
ROWS_PER_BUCKET = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key of rate ``weight``, from 52 bits of an md5: the same on every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its words, rows and target.  One row a source, so its windows are over a small table."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (place + 1).cast("int")).cast("double"))
    s = s.withColumn("stop", (F.col("source_size") * max_epochs).cast("double"))
    order = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    level = F.min_by(F.when(F.col("stop") / F.col("w") >= F.col("level"), F.col("level")),
                     F.when(F.col("stop") / F.col("w") >= F.col("level"), F.col("place"))).over(everything)
    return s.select("source", "source_size", "source_rows", F.least("stop", F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def mix_table(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """``sizes`` (columns doc_id, source, size, weight, and any others) with ``source_size, target, copies``."""
    given = sizes.columns
    targets = written(source_targets(sizes, weights, max_epochs), "targets")
    t = targets.withColumnRenamed("source", "of_source")
    d = sizes.join(t, sizes.source.eqNullSafe(t.of_source))
    d = d.withColumn("key", sampling_key(F.col("doc_id"), F.col("weight"), seed))
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    d = d.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    buckets = F.greatest(F.lit(64), F.ceil(F.col("source_rows") / ROWS_PER_BUCKET))
    d = d.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key")))))
    totals = d.groupBy("of_source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("of_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    totals = totals.select(F.col("of_source").alias("s"), F.col("bucket").alias("b"), "before", "bucket_size")
    d = d.join(totals, d.of_source.eqNullSafe(totals.s) & (d.bucket == totals.b))
    d = d.withColumn("border", (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest")))
    keep = [*given, "source_size", "target", "epochs"]
    inner = d.filter("not border").select(*keep, (F.col("before") + F.col("bucket_size") <= F.col("rest")).cast("int").alias("extra"))
    rows = W.partitionBy("of_source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = d.filter("border").withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(rows), F.lit(0)))
    edge = edge.select(*keep, (F.col("prefix") + F.col("size") / 2 <= F.col("rest")).cast("int").alias("extra"))
    return inner.unionByName(edge).select(*given, "source_size", "target", (F.col("epochs") + F.col("extra")).alias("copies"))


def document_sizes(documents: DataFrame, quality: DataFrame | None = None, *more: str) -> DataFrame:
    """doc_id, source, ``more``, size, weight.  ``quality``: doc_id and quality 0 or 1, which weigh 0.5 and 2 (unknown: 1)."""
    d = documents.select("doc_id", "source", *more, n_words(F.col("text")).alias("size"))
    if quality is None:
        return d.withColumn("weight", F.lit(1.0))
    q = quality.filter("doc_id is not null").groupBy(F.col("doc_id").alias("q_id")).agg(F.max("quality").alias("quality"))
    return d.join(q, d.doc_id == q.q_id, "left").select(
        "doc_id", "source", *more, "size", F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") <= 0, 0.5).otherwise(1.0).alias("weight"))


def mix_documents(documents: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``."""
    prepare(documents.sparkSession)
    sizes = written(document_sizes(documents, quality), "sizes")
    return mix_table(sizes).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(documents: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix itself: every row of ``documents``, with all its columns, as often as it is taken.

    ``quality`` is that of :func:`document_sizes`.
    Only (row hash, copies) meets the texts again.  Rows of equal ``doc_id``,
    text and source are one row here, which gives the copies of them all.
    """
    prepare(documents.sparkSession)
    row = F.xxhash64("doc_id", "text", "source")
    sizes = written(document_sizes(documents.select("doc_id", "source", "text", row.alias("row")), quality, "row"), "sizes")
    copies = mix_table(sizes).groupBy(F.col("row").alias("mix_row")).agg(F.sum("copies").cast("int").alias("mix_copies"), F.count("*").alias("mix_equal"))
    d = documents.join(copies.filter("mix_copies > 0"), row == F.col("mix_row"))
    alone = d.filter("mix_equal = 1").unionByName(d.filter("mix_equal > 1").dropDuplicates(["mix_row"]))
    return alone.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*documents.columns)
