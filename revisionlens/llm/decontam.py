"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

1. The words of the benchmark are counted over all documents (map-side sums).
2. Of each window of 13 consecutive item words (a shorter item is one window)
   the two rarest words are its anchors.
3. The index holds the postings (term, document, position) of all anchors: one
   pass over the texts, written to the shared checkpoint folder.
4. Each posting is moved by its anchor's place in the item; postings that agree
   on (document, item, offset) are an intersection of offset-adjusted lists.
5. Intersections are compared word by word, for the exact phrase matches.
6. Proximity matches find reworded copies: documents that hold several different
   terms of an item within a distance.  Its terms are its anchors and its
   ``NEAR_TERMS`` rarest words (beyond ``LEAST`` of them only such as stand less
   often than there are documents); an item with fewer terms than the match asks
   for must have all of them near each other.

Terms are found by ``lower()`` of the single word, which joins at least all that
are equal after lower-casing A-Z; the last comparison is exact.  Broadcast:
only term and id lists whose counted rows are within ``BROADCAST_IDS``; beyond it
the same joins shuffle.  A word in a third of all positions is an anchor only of
items that have no rarer word.

Nulls and odd input: null texts have no words (and an item without words no
window); documents with a null ``doc_id`` are judged by their own text like any other; items with a null ``item_id`` are left out; rows that repeat a ``doc_id`` are
judged by their own text, equal rows alike; empty tables give every document
without hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisionlens.llm.common import ascii_lower, checked_broadcast, prepare, written

WINDOW = 13
ANCHORS = 2                   # rarest words of a window whose lists are intersected
NEAR_TERMS, DISTANCE, LEAST = 6, 50, 3
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"      # the words before A-Z are lower-cased


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.array().cast("array<string>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words (exact: A-Z lowered), n; items of equal id are told apart by ``item``."""
    b = benchmark.filter("item_id is not null").select("item_id", words_of(ascii_lower(F.col("text"))).alias("words")).distinct()
    return b.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n")).filter("n > 0")


def _positions(docs: DataFrame) -> DataFrame:
    """doc_id, row, n, pos, word; position 0 is the empty word, which every document has once (words start at 1)."""
    w = docs.select("doc_id", "row", words_of(F.col("text")).alias("words"))
    return w.select("doc_id", "row", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))


def build_index(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, anchors): the written index over the anchors' terms, and the anchors (term, item, at, n, phrase).

    ``phrase`` is false for the terms that only the proximity matches need.
    """
    prepare(documents.sparkSession)
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row"))
    spots = items.select("item", "n", F.posexplode("words").alias("at", "word")).select("item", "n", "at", F.lower("word").alias("term"))
    spots = written(spots, "spots")
    empty = documents.sparkSession.createDataFrame([("",)], "term string")          # stands once in every document
    terms = written(spots.select("term").unionByName(empty).distinct(), "terms")
    words = _positions(docs)
    counts = words.select(F.lower("word").alias("term")).join(checked_broadcast(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("frequency"))
    counts = written(counts, "frequencies")
    spots = written(spots.join(counts, "term"), "known")         # a word that no document has: its windows occur nowhere
    n_docs = counts.filter("term = ''").select(F.col("frequency").alias("n_docs"))          # one row, or none without documents
    own = spots.groupBy("item", "term", "frequency", "n").agg(F.min("at").alias("at"))
    own = own.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy("frequency", "term"))).join(F.broadcast(n_docs), F.lit(True))
    near = own.filter(f"place <= {LEAST} or place <= {NEAR_TERMS} and frequency <= n_docs").select("term", "item", "at", "n", F.lit(False).alias("phrase"))
    width = F.least(F.lit(WINDOW), F.col("n"))
    first = F.greatest(F.lit(0), F.col("at") - width + 1)
    last = F.least(F.col("at"), F.col("n") - width)
    spots = spots.withColumn("window", F.explode(F.sequence(first, last)))
    rarest = F.row_number().over(W.partitionBy("item", "window").orderBy("frequency", "term", "at"))
    anchors = spots.withColumn("place", rarest).filter(F.col("place") <= ANCHORS).select("term", "item", "at", "n", F.lit(True).alias("phrase")).distinct()
    anchors = written(anchors.unionByName(near), "anchors")
    wanted = written(anchors.select("term").unionByName(empty).distinct(), "wanted")
    postings = words.select("doc_id", "row", "n", "pos", F.lower("word").alias("term")).join(checked_broadcast(wanted, wanted.count()), "term")
    return written(postings.select("term", "doc_id", "row", "n", "pos"), "postings"), anchors


def phrase_matches(documents: DataFrame, items: DataFrame, postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every exact match: ``doc_id, row, item_id, pos`` of each document word that a window of the item covers."""
    moved = postings.filter("pos > 0").select("term", "doc_id", "row", "pos").join(anchors.filter("phrase").select("term", "item", "at", F.col("n").alias("item_n")), "term")
    moved = moved.select("doc_id", "row", "item", "item_n", (F.col("pos") - 1 - F.col("at")).alias("offset"))
    met = moved.groupBy("doc_id", "row", "item", "offset").agg(F.count("*").alias("terms"), F.first("item_n").alias("item_n"))
    met = met.filter(F.col("terms") >= F.least(F.lit(ANCHORS), F.col("item_n"))).select("doc_id", "row", "item", "offset")
    met = written(met, "met")
    ids = written(met.select("doc_id", "row").distinct(), "met-ids")
    ids = checked_broadcast(ids.select(F.col("doc_id").alias("d"), F.col("row").alias("r")), ids.count())
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row")).join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left_semi")
    docs = docs.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), words_of(ascii_lower(F.col("text"))).alias("doc_words")).dropDuplicates(["d", "r"])
    both = met.join(docs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).join(items.select("item", "item_id", "words", "n"), "item")
    equal = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.get("doc_words", F.col("offset") + i) == F.get("words", i), F.lit(False)))
    both = both.select("doc_id", "row", "item_id", "offset", "n", equal.alias("equal")).filter(F.array_contains("equal", True))
    width = F.least(F.lit(WINDOW), F.col("n"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - width), lambda j: ~F.array_contains(F.slice("equal", j + 1, width), False))
    found = both.select("doc_id", "row", "item_id", "offset", width.alias("width"), starts.alias("starts")).filter(F.size("starts") > 0)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda j: F.sequence(j, j + F.col("width") - 1))))
    return found.select("doc_id", "row", "item_id", F.explode(covered).alias("i"), "offset").select("doc_id", "row", "item_id", (F.col("offset") + F.col("i")).alias("pos"))


def proximity_matches(postings: DataFrame, anchors: DataFrame, items: DataFrame, distance: int = DISTANCE, least: int = LEAST) -> DataFrame:
    """(doc_id, row, item_id, terms): documents with at least ``least`` different terms of an item (all, if it has fewer) within ``distance`` words.

    ``terms`` is the most that stand so: their first and last position are at most ``distance`` apart.
    """
    terms = anchors.select("term", "item").distinct()
    asked = terms.groupBy("item").agg(F.least(F.lit(least), F.count("*")).alias("asked"))
    hits = postings.filter("pos > 0").select("term", "doc_id", "row", "pos").distinct().join(terms.join(asked, "item"), "term")
    # a block and the next hold every span that begins in it: only spans in blocks with enough terms are looked at
    block = F.floor(F.col("pos") / (distance + 1))
    blocks = hits.select("doc_id", "row", "item", "asked", "term", "pos", block.alias("own"), F.explode(F.array(block - 1, block)).alias("block"))
    full = blocks.groupBy("doc_id", "row", "item", "block").agg(F.collect_set("term").alias("held"), F.collect_list(F.struct("pos", "term")).alias("spots"), F.first("asked").alias("asked"))
    full = full.filter(F.size("held") >= F.col("asked")).select("doc_id", "row", "item", "block", "asked", F.explode("spots").alias("spot"))
    span = W.partitionBy("doc_id", "row", "item", "block").orderBy("pos").rangeBetween(0, distance)
    near = full.select("doc_id", "row", "item", "asked", "block", F.col("spot.pos").cast("long").alias("pos"), F.col("spot.term").alias("term"))
    near = near.withColumn("terms", F.size(F.collect_set("term").over(span)))
    near = near.groupBy("doc_id", "row", "item").agg(F.max("terms").cast("long").alias("terms"), F.first("asked").alias("asked")).filter("terms >= asked")
    return near.join(items.select("item", "item_id"), "item").groupBy("doc_id", "row", "item_id").agg(F.max("terms").alias("terms"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document ``doc_id, row, n_words, n_hit, items (sorted as strings), contaminated, near_items, near_terms``.

    ``near_items`` are those of the proximity matches (sorted as strings), ``near_terms`` the most terms of one.
    They don't decide on ``contaminated``.
    """
    prepare(documents.sparkSession)
    items = written(_items(benchmark), "items")
    postings, anchors = build_index(documents, items)
    hits = phrase_matches(documents, items, postings, anchors)
    spots = hits.groupBy("doc_id", "row", "pos").agg(F.collect_set(F.col("item_id").cast("string")).alias("at"))
    found = spots.groupBy("doc_id", "row").agg(F.count("*").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("items"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_hit", "items")
    every = postings.filter("pos = 0").select("doc_id", "row", F.col("n").cast("long").alias("n_words"))
    out = every.join(found, every.doc_id.eqNullSafe(found.d) & (every.row == found.r), "left")
    near = proximity_matches(postings, anchors, items).groupBy(F.col("doc_id").alias("near_d"), F.col("row").alias("near_r")).agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"), F.max("terms").alias("near_terms"))
    out = out.join(near, F.col("doc_id").eqNullSafe(F.col("near_d")) & (F.col("row") == F.col("near_r")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
                      F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"), F.coalesce("near_terms", F.lit(0)).cast("long").alias("near_terms"))
