"""Corpus selection, joins and nesting over matched arcs and sentences.

Arcs are ``matched_sentences`` rows (``source, entry_id, version_x, version_y,
sent_idx_x, sent_idx_y, avg_sentence_distance_x, avg_sentence_distance_y``);
sentences are ``split_sentences`` rows.  Keys are typed columns, so selections
are semi joins the planner can run as broadcast or shuffled joins by size.
Nested records are sorted inside the aggregate (``array_sort``), never by
relying on the order of ``collect_list``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["source", "entry_id", "version_x", "version_y"]
VERSION = ["source", "entry_id", "version"]


def versions_by_size(sentences: DataFrame, low: int = 3, high: int = 15) -> DataFrame:
    """A1: versions whose sentence count c has low < c < high (strict)."""
    c = sentences.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("c"))
    return c.filter((F.col("c") < high) & (F.col("c") > low)).select(*VERSION)


def pair_version_keys(arcs: DataFrame) -> DataFrame:
    """A2: distinct (source, entry_id, version) found on either side of an arc."""
    return (arcs.select("source", "entry_id",
                        F.explode(F.array("version_x", "version_y")).alias("version"))
                .distinct())


def select_by_keys(arcs: DataFrame, sentences: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: arcs whose both versions are in ``keys``; sentences whose version is."""
    k = keys.select(*VERSION)
    kx = k.withColumnRenamed("version", "version_x")
    ky = k.withColumnRenamed("version", "version_y")
    a = (arcs.join(kx, ["source", "entry_id", "version_x"], "left_semi")
             .join(ky, ["source", "entry_id", "version_y"], "left_semi"))
    s = sentences.join(k, VERSION, "left_semi")
    return a, s


def arcs_with_text(arcs: DataFrame, sentences: DataFrame, how: str = "inner") -> DataFrame:
    """A4: attach both sentence texts to arcs (``inner`` or ``full_outer``)."""
    sx = sentences.select("source", "entry_id", F.col("version").alias("version_x"),
                          F.col("sent_idx").alias("sent_idx_x"), F.col("sentence").alias("sentence_x"))
    sy = sentences.select("source", "entry_id", F.col("version").alias("version_y"),
                          F.col("sent_idx").alias("sent_idx_y"), F.col("sentence").alias("sentence_y"))
    # numbers first in the sorts: all entries may share a source
    out = (arcs.join(sx, ["entry_id", "version_x", "sent_idx_x", "source"], how)
               .join(sy, ["entry_id", "version_y", "sent_idx_y", "source"], how))
    first = ["source", "entry_id", "version_y", "sent_idx_y", "version_x", "sent_idx_x"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def filter_by_distance(arcs: DataFrame, min_distance: float = 0.1) -> DataFrame:
    """A5: arcs with both distances above ``min_distance`` (NULLs drop)."""
    return arcs.filter((F.col("avg_sentence_distance_x") > min_distance)
                       & (F.col("avg_sentence_distance_y") > min_distance))


def sentence_keys_union(arcs: DataFrame) -> DataFrame:
    """Distinct sentence keys on either side of the arcs."""
    x = arcs.select("source", "entry_id", F.col("version_x").alias("version"),
                    F.col("sent_idx_x").alias("sent_idx"))
    y = arcs.select("source", "entry_id", F.col("version_y").alias("version"),
                    F.col("sent_idx_y").alias("sent_idx"))
    return x.unionByName(y).filter(F.col("sent_idx").isNotNull()).distinct()


def nest_arcs(arcs: DataFrame, with_distances: bool = True, label_col: str | None = None) -> DataFrame:
    """The arcs of one version pair as a sorted list of records."""
    fields = ["version_x", "version_y", "sent_idx_x", "sent_idx_y"]
    if with_distances:
        fields += ["avg_sentence_distance_x", "avg_sentence_distance_y"]
    if label_col:
        fields.append(label_col)
    return arcs.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("arcs"))


def nest_nodes(sentences: DataFrame, label_col: str | None = None) -> DataFrame:
    """The sentences of one version as a list of records ordered by index."""
    fields = ["version", "sent_idx", "sentence"] + ([label_col] if label_col else [])
    return sentences.groupBy(*VERSION).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))


def pair_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of version v followed by nodes of version v + 1."""
    a = nodes.select("source", "entry_id", F.col("version").alias("version_x"), F.col("nodes").alias("nx"))
    b = nodes.select("source", "entry_id", (F.col("version") - 1).alias("version_x"), F.col("nodes").alias("ny"))
    return (a.join(b, ["source", "entry_id", "version_x"])
             .select("source", "entry_id", "version_x", (F.col("version_x") + 1).alias("version_y"),
                     F.concat("nx", "ny").alias("nodes")))


def match_records(arcs: DataFrame, sentences: DataFrame, display: bool = True) -> DataFrame:
    """A10: per version pair, nodes and arcs side by side (pairs present on one side only stay)."""
    from revisionlens.operators.text import display_sentences
    s = display_sentences(sentences) if display else sentences
    return pair_nodes(nest_nodes(s)).join(nest_arcs(arcs), PAIR, "full_outer")


def count_matched_pairs(arcs: DataFrame) -> DataFrame:
    """Number of distinct (entry, version_x, version_y)."""
    return arcs.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("count_matched_versions"))


def versions_per_entry(doc_stats: DataFrame) -> DataFrame:
    """Rows per entry in a per-pair table."""
    return doc_stats.groupBy("source", "entry_id").agg(F.count(F.lit(1)).alias("num_versions"))


def growing_articles(doc_stats: DataFrame, early: float = 0.2, max_sentences: int = 20,
                     min_growth: float = 0.4) -> DataFrame:
    """Early pairs of short articles that grow."""
    nv = versions_per_entry(doc_stats)
    d = doc_stats.join(nv, ["source", "entry_id"])
    return d.filter((F.col("version_x") / F.col("num_versions") < early)
                    & (F.col("num_sentences_x") < max_sentences)
                    & (F.col("num_added") / F.col("num_sentences_x") > min_growth))


def head(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """First n rows in key order (a bounded top-n: per-task top-n, then merge)."""
    return df.orderBy(*keys).limit(n)


def nth_pair(arcs: DataFrame, n: int) -> DataFrame:
    """The arcs of the n-th (0-based) distinct version pair in key order."""
    p = arcs.select(*PAIR).distinct().orderBy(*PAIR).offset(n).limit(1)
    return arcs.join(p, PAIR, "left_semi")


def min_max_version(records: DataFrame) -> DataFrame:
    """Lowest and highest version inside a record's nodes decide its sides."""
    vs = F.transform("nodes", lambda n: n["version"])
    return records.withColumn("x_version", F.array_min(vs)).withColumn("y_version", F.array_max(vs))
