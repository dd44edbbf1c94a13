"""Line deduplication across documents, in DataFrame functions only.

Lines are exploded once; a line's key (ends stripped, A-Z lower-cased) travels
as a 128-bit hash, never as text.  Documents are counted per hash with map-side
partial sums, so a line in a third of all documents is one row a task before
the shuffle.  The positions to drop then meet their document once, and the
other lines are joined again by position.

Nulls and odd input: a null or empty text is one empty line; a document with a
null ``doc_id`` is counted under no id, so its lines count for no document and
stay; repeated rows of a ``doc_id`` count as one document and are all treated
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import ascii_lower, prepare, written

MIN_CHARS, MIN_DOCUMENTS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document ``doc_id, n_lines, n_dropped, kept_text``.

    A key of at least ``min_chars`` code points found in at least
    ``min_documents`` documents loses its lines except in the largest ``doc_id``
    that holds it.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    each = docs.filter("doc_id is not null").select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    each = each.filter(F.length("line") >= min_chars).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    each = written(each.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")

    # a line that repeats within one document counts once: distinct (hash, document), then counts
    held = each.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = held.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last")).filter(F.col("documents") >= min_documents)
    dropped = each.join(common, ["h1", "h2"]).filter("doc_id != last")
    dropped = dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))

    out = docs.join(dropped, docs.doc_id.eqNullSafe(dropped.doc_id) & docs.row.eqNullSafe(dropped.row), "left").select(docs.doc_id, docs.text, "dropped")
    lines = lines_of(F.col("text"))
    out = out.withColumn("lines", lines)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
