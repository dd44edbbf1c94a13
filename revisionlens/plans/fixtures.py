"""Inputs derived by Spark from the given tables (never stored).

* ``conversation_articles``: conversations as versioned articles
  (conv_id -> entry_id, turn -> version, text -> summary).
* ``revision_sentences``: a three-version revision history planted in
  ``documents`` by integer rules (deletes, edits, moves, additions), built per
  document inside one row (array functions), so only the documents are dealt, once.
* ``trigram_lexicon``: a word -> vector table built from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisionlens.functions import constants as K
from revisionlens.functions import text as X
from revisionlens.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: one row per version (``entry_id, version, summary, source``)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("long").alias("entry_id"),
                    F.col("turn").cast("int").alias("version"),
                    F.col("text").alias("summary"),
                    F.lit("conversations").alias("source"))


# FIXED VALUES of the planted revision history (integer rules on (i + doc_id)).
_V1_DELETE = "(x.i + doc_id) % 11 = 4"
_V2_DELETE = "(x.i + doc_id) % 13 = 6"
_V1_EDIT = "(x.i + doc_id) % 9 = 2"
_V1_MOVE_UP = "(x.i + doc_id) % 17 = 8"
_V1_ADD = "(x.i + doc_id) % 10 = 7"


#: A document of more sentences than this may have a version pair of more than 2^20 sentence pairs (its versions add at most one line a sentence).
LONG_DOCUMENT = 512


def long_documents(spark: SparkSession, sf_dir: str, longest: int = LONG_DOCUMENT) -> DataFrame:
    """The documents whose texts (of a key together) hold more than ``longest`` end marks, so the few that may have so many sentences."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    flat = rest = F.replace(F.col("text"), F.lit(K.PARAGRAPH_SEP), F.lit("\n"))
    for mark in ".!?\n":
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    most = F.octet_length(flat) - F.octet_length(rest) + 1                        # each sentence but the last has one before the next
    keys = d.groupBy("source", "doc_id").agg(F.sum(most).alias("most")).filter(F.col("most") > longest).select("source", "doc_id")
    return d.join(materialize(keys, "long-documents"), ["source", "doc_id"], "left_semi")


def _versions(documents: DataFrame) -> DataFrame:
    """``doc_id, source, ver`` (``v``, and ``a``: the version's sentences ``s`` in order): a row for each version of each document.

    The documents are dealt by key before their versions are made (a table of few row groups is split by many tasks) and
    sorted by it, so all rows of a key lie together.
    """
    d = (documents.select("doc_id", "source", "text").repartition("source", "doc_id").sortWithinPartitions("doc_id", "source")
         .select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                 X.sentence_array(F.col("text")).alias("sents")))
    d = d.withColumn("idx", F.expr("transform(sents, (s, i) -> named_struct('i', i, 's', s))"))
    kept = f"""transform(filter(idx, x -> NOT ({_V1_DELETE}){{extra}}),
                 x -> named_struct('k', CASE WHEN {_V1_MOVE_UP} THEN x.i - 3.5 ELSE CAST(x.i AS DOUBLE) END,
                                   's', CASE WHEN {_V1_EDIT} THEN concat('Update ', x.s) ELSE x.s END))"""
    added = f"""transform(filter(idx, x -> {_V1_ADD}),
                 x -> named_struct('k', x.i + 0.5, 's', concat('Added line ', doc_id, ' ', x.i, '.')))"""
    v0 = "transform(idx, x -> named_struct('k', CAST(x.i AS DOUBLE), 's', x.s))"
    v1 = f"concat({kept.format(extra='')}, {added})"
    v2 = f"concat({kept.format(extra=f' AND NOT ({_V2_DELETE})')}, {added})"
    versions = F.expr(f"""array(named_struct('v', 0, 'a', array_sort({v0})),
                                named_struct('v', 1, 'a', array_sort({v1})),
                                named_struct('v', 2, 'a', array_sort({v2})))""")
    return d.select("doc_id", "source", F.explode(versions).alias("ver"))


def revision_sentences(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Split sentences of versions 0, 1, 2 of each document (all, or those given).

    ``sent_idx`` = rank of (order key, text) within the version, from 0.  An article's rows lie together in one task.
    """
    ex = _versions(table(spark, sf_dir, "documents") if documents is None else documents)
    return ex.select(F.col("source"), F.col("doc_id").alias("entry_id"),
                     F.col("ver.v").cast("int").alias("version"),
                     F.posexplode("ver.a").alias("sent_idx", "kv")) \
             .select("source", "entry_id", "version", F.col("sent_idx").cast("int").alias("sent_idx"),
                     F.col("kv.s").alias("sentence"))


def revision_articles(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """The revision fixture as articles: sentences joined by newlines; an article's rows lie together in one task.

    A version of a document is joined in its row; only where keys repeat are the versions' sentences merged in order.
    """
    d = (table(spark, sf_dir, "documents") if documents is None else documents).select("doc_id", "source", "text")
    keys = d.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    repeated = materialize(keys.filter("n > 1").select("source", "doc_id"), "repeated-documents")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("d.source").eqNullSafe(F.col("r.source"))
    some = bool(repeated.head(1))
    once = _versions(d.alias("d").join(repeated.alias("r"), same, "left_anti") if some else d)
    text = F.array_join(F.col("ver.a").getField("s"), "\n")
    once = once.select("source", F.col("doc_id").alias("entry_id"), F.col("ver.v").cast("int").alias("version"), text.alias("summary")).filter(F.size("ver.a") > 0)
    if not some:
        return once
    s = revision_sentences(spark, sf_dir, d.alias("d").join(repeated.alias("r"), same, "left_semi"))
    merged = (s.groupBy("source", "entry_id", "version")
               .agg(F.array_join(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).getField("sentence"),
                                 "\n").alias("summary")))
    return once.unionByName(merged.repartition("source", "entry_id").sortWithinPartitions("entry_id", "source", "version"))


def trigram_lexicon(spark: SparkSession, sf_dir: str, tokens: DataFrame, dim: int = 64) -> DataFrame:
    """Context-free word vectors: L2-normalised sum of ``embeddings`` rows picked
    by the md5 bucket of each character trigram of ``<word>``.

    Words sharing trigrams get related vectors (0 < d < 1); equal words get
    equal vectors.  All of it is DataFrame work: the trigrams of the distinct
    words, a join with the whole ``embeddings`` table by bucket, and one sum a
    dimension.  The modulus is the table's own size.
    """
    e = table(spark, sf_dir, "embeddings")
    size = e.agg((F.max("vec_id") + 1).alias("size")).first()["size"] or 1
    padded = F.concat(F.lit("<"), F.col("token"), F.lit(">"))
    grams = tokens.select("token").distinct().select(
        "token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substr(padded, i, F.lit(3)))).alias("gram"))
    bucket = F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long") % F.lit(size)
    grams = grams.groupBy("token", bucket.alias("vec_id")).agg(F.count("*").alias("n"))
    parts = grams.join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id")
    sums = parts.groupBy("token").agg(*[F.sum(F.col("n") * F.col("e")[k]).alias(f"d{k}") for k in range(dim)])
    norm = F.greatest(F.sqrt(sum((F.col(f"d{k}") * F.col(f"d{k}") for k in range(1, dim)), F.col("d0") * F.col("d0"))), F.lit(1e-300))
    return sums.select("token", F.array(*[F.col(f"d{k}") / norm for k in range(dim)]).alias("vector"))


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as single-version articles (doc_id -> entry_id, version 0)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("long").alias("entry_id"), F.lit(0).alias("version"),
                    F.col("text").alias("summary"), "source")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as single-version articles (page_id -> entry_id)."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("long").alias("entry_id"), F.lit(0).alias("version"),
                    F.col("html").alias("summary"), F.lit("pages").alias("source"))
