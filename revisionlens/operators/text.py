"""Text preparation operators (T1-T11): versions -> sentences -> tokens.

All of them are projections, array lambdas and one ``posexplode``: narrow
transformations that keep whole-stage codegen and never shuffle, except
``explode_tokens`` which needs a document-wide word index (one window) and
``content_words`` with a lemma table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisionlens.functions import constants as K
from revisionlens.functions import text as X


def clean_markup(df: DataFrame, col: str = "summary", out: str | None = None) -> DataFrame:
    """Strip scraped-page furniture from a ``</p><p>``-joined summary.

    Drops a last line "Currently monitoring N news articles", a first line that
    is a link, then a first "Version N of M" line; rejoins; strips one outer
    ``<p>``/``</p>``; deletes escaped tags ``&lt;..&gt;``.  An article whose
    lines are all dropped becomes the empty string.
    """
    out = out or col
    lines = "__lines"
    d = df.withColumn(lines, F.split(F.col(col), "</p><p>", -1))
    n = F.size(F.col(lines))
    d = d.withColumn(lines, F.when(
        (n > 0) & F.try_element_at(F.col(lines), F.lit(-1)).rlike(K.LAST_LINE_PATTERN),
        F.slice(F.col(lines), 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.col(lines)))
    n = F.size(F.col(lines))
    for pred in (lambda first: first.startswith(K.FIRST_LINE_LINK_PREFIX),
                 lambda first: first.rlike(K.VERSION_LINE_PATTERN)):
        d = d.withColumn(lines, F.when(
            (n > 0) & pred(F.try_element_at(F.col(lines), F.lit(1))),
            F.slice(F.col(lines), 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.col(lines)))
        n = F.size(F.col(lines))
    joined = F.array_join(F.col(lines), K.PARAGRAPH_SEP)
    d = d.withColumn(lines, F.when(joined.startswith("<p>"), F.expr("substr(array_join(__lines, '</p><p>'), 4)"))
                     .otherwise(joined))
    d = d.withColumn(lines, F.when(F.col(lines).endswith("</p>"),
                                   F.expr("substr(__lines, 1, length(__lines) - 4)")).otherwise(F.col(lines)))
    d = d.withColumn(lines, F.regexp_replace(F.col(lines), K.ESCAPED_TAG_PATTERN, ""))
    return d.withColumn(out, F.col(lines)).drop(lines) if out != lines else d


def sentence_list(text, *, drop_boilerplate: bool = False, drop_templates: bool = False,
                  merge_dateline: bool = False, countries: list[str] | None = None):
    """Column: ordered sentences of one version after the optional filters."""
    if merge_dateline:
        sents = X.sentence_array(text)
        for dash in reversed(K.DATELINE_DASHES):   # first dash wins: build inner-out
            head = F.substring_index(text, dash, 1)
            tail = F.substr(text, F.instr(text, dash) + 1)
            hit = (F.instr(text, dash) > 0) & X.is_dateline(head, countries)
            sents = F.when(hit, F.concat(F.array(F.trim(head)), X.sentence_array(F.trim(tail)))).otherwise(sents)
    else:
        sents = X.sentence_array(text)
    if drop_boilerplate:
        sents = F.filter(sents, lambda s: ~X.is_boilerplate(s))
    sents = F.filter(F.transform(sents, lambda s: F.trim(s)), lambda s: s != "")
    if merge_dateline:
        first_is = (F.size(sents) > 0) & X.is_dateline(F.try_element_at(sents, F.lit(1)), countries)
        merged = F.concat(
            F.array(F.array_join(F.slice(sents, 1, 2), K.DATELINE_DASHES[0])),
            F.slice(sents, 3, F.greatest(F.size(sents) - 2, F.lit(0))))
        sents = F.when(first_is, merged).otherwise(sents)
    if drop_templates:
        sents = F.filter(sents, lambda s: ~X.is_template_line(s))
    return sents


def split_sentences(articles: DataFrame, text_col: str = "summary", *, clean: bool = False,
                    drop_boilerplate: bool = False, drop_templates: bool = False,
                    merge_dateline: bool = False, countries: list[str] | None = None,
                    keep: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """T3 (+T1/T4/T5/T6): one row per sentence, ``sent_idx`` dense from 0.

    Filters run on the sentence array before ``posexplode``, so indices are
    already renumbered and no window/shuffle is needed.  ``keep``: further columns to carry;
    ``keep_empty``: a version without sentences is one row without ``sent_idx``.
    """
    d = articles
    if clean:
        d = clean_markup(d, text_col, "__clean")
        text = F.col("__clean")
    else:
        text = F.col(text_col)
    sents = sentence_list(text, drop_boilerplate=drop_boilerplate, drop_templates=drop_templates,
                          merge_dateline=merge_dateline, countries=countries)
    exploded = F.posexplode_outer(sents) if keep_empty else F.posexplode(sents)
    return (d.select("source", "entry_id", *(keep or []), F.col("version").cast("int").alias("version"),
                     exploded.alias("sent_idx", "sentence"))
             .withColumn("sent_idx", F.col("sent_idx").cast("int")))


def paragraphs(articles: DataFrame, text_col: str = "summary") -> DataFrame:
    """One row per paragraph with its 0-based index."""
    return articles.select("source", "entry_id", "version",
                           F.posexplode(X.split_paragraphs(F.col(text_col))).alias("par_idx", "paragraph"))


def drop_boilerplate(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """T5 as a row filter."""
    return sentences.filter(~X.is_boilerplate(F.col(col)))


def drop_template_lines(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """T6 as a row filter."""
    return sentences.filter(~X.is_template_line(F.col(col)))


def tokenize(sentences: DataFrame, method: str = "regex") -> DataFrame:
    """T7 + T10: token array and its size (``num_words``) per sentence."""
    toks = X.tokens(F.col("sentence"), method)
    return sentences.withColumn("tokens", toks).withColumn("num_words", F.size("tokens").cast("long"))


def content_words(sentences: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Content words per sentence; an optional ``(word, lemma)`` table maps words first."""
    d = sentences.withColumn("content_words", X.content_words(X.tokens(F.col("sentence"))))
    if lemmas is None:
        return d
    # rows are dealt by all they hold, so that no common sentence is hot, and each part gets the lemma of each of its
    # distinct words once (the dictionary may be large); rows stay whole: those without words stay, equal ones don't merge
    lemma = lemmas.groupBy("word").agg(F.lower(F.min("lemma")).alias("lemma"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = d.schema
    d = d.withColumn("__part", F.pmod(F.xxhash64(*[f.name for f in schema if not isinstance(f.dataType, T.MapType)]), F.lit(parts)).cast("int"))
    known = (d.repartitionById(parts, "__part").select("__part", F.explode("content_words").alias("word")).distinct().join(lemma, "word")
              .select("__part", F.lit(0).alias("__kind"), F.col("word").alias("__word"), F.col("lemma").alias("__lemma")))
    dealt = d.withColumn("__kind", F.lit(1)).unionByName(known, allowMissingColumns=True).repartitionById(parts, "__part")
    mapped = dealt.sortWithinPartitions("__kind").mapInArrow(_map_words(schema.names), schema)
    return mapped.withColumn("content_words", X.content_words(F.col("content_words")))


def _map_words(names: list[str]):
    """A part's (word, lemma) rows, then its rows with words -> those rows with their words mapped."""
    def run(batches):
        words, lemmas = [pa.array([], pa.string())], [pa.array([], pa.string())]
        for b in batches:
            k = int(np.searchsorted(b.column("__kind").to_numpy(), 1))
            if k:
                words.append(b.column("__word").slice(0, k))
                lemmas.append(b.column("__lemma").slice(0, k))
            if k == b.num_rows:
                continue
            if len(words) > 1:
                words, lemmas = [pa.concat_arrays(words)], [pa.concat_arrays(lemmas)]
            b = b.slice(k).select(names)
            lists = b.column("content_words")
            flat = lists.flatten()
            if len(words[0]):
                flat = pc.coalesce(lemmas[0].take(pc.index_in(flat, value_set=words[0])), flat)
            at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            mapped = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, type=lists.type, mask=pc.is_null(lists))
            yield b.set_column(names.index("content_words"), "content_words", mapped)
    return run


def explode_tokens(sentences: DataFrame, method: str = "regex") -> DataFrame:
    """One row per token; ``word_idx`` counts over the whole version.

    The running offset of each sentence is a windowed sum over the version (one
    shuffle keyed by the version); everything else is per row.
    """
    t = tokenize(sentences, method)
    w = Window.partitionBy("source", "entry_id", "version").orderBy("sent_idx") \
              .rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("offset", F.coalesce(F.sum("num_words").over(w), F.lit(0)))
    return (t.select("source", "entry_id", "version", "sent_idx", "num_words", "offset",
                     F.posexplode("tokens").alias("pos", "token"))
             .select("source", "entry_id", "version", "sent_idx", "num_words",
                     (F.col("offset") + F.col("pos")).cast("int").alias("word_idx"), "token"))


def display_sentences(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """Sentence text prepared for display."""
    return sentences.withColumn(col, X.display_text(F.col(col)))
