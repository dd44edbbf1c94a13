"""Column expressions for text preparation (all JVM-side, inside codegen).

Each function takes and returns ``Column`` objects so callers can compose them
in one projection.  Array lambdas (``filter``/``exists``/``transform``) keep
per-sentence logic inside a single row, so no shuffle is needed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from revisionlens.functions import constants as K


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_paragraphs(text: Column) -> Column:
    """Paragraphs of a summary (split on the literal ``</p><p>``)."""
    return F.split(text, "</p><p>", -1)


def sentence_array(text: Column) -> Column:
    """T3 core: ``</p><p>`` and newlines end a sentence; trimmed, empties dropped."""
    flat = F.replace(text, F.lit(K.PARAGRAPH_SEP), F.lit("\n"))
    raw = F.regexp_extract_all(flat, F.lit(K.SENTENCE_PATTERN), 0)
    return F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: s != "")


def is_boilerplate(sentence: Column, phrases: list[str] | None = None) -> Column:
    """T5 predicate: lower-cased text contains one of the boilerplate phrases (lower-cased once, then searched for each)."""
    every = sorted({p.lower() for p in (K.BOILERPLATE_PHRASES if phrases is None else phrases)})
    if not every:
        return F.lit(False)
    return F.exists(F.array(F.lower(sentence)), lambda text: reduce(or_, [F.contains(text, F.lit(p)) for p in every]))


def is_template_line(sentence: Column) -> Column:
    """T6 predicate (case-sensitive): starts with / contains / ends with a marker."""
    cond = F.lit(False)
    for p in K.TEMPLATE_STARTS_WITH:
        cond = cond | sentence.startswith(p)
    for p in K.TEMPLATE_CONTAINS:
        cond = cond | (F.instr(sentence, p) > 0)
    for p in K.TEMPLATE_ENDS_WITH:
        cond = cond | sentence.endswith(p)
    return cond


def drop_boilerplate_text(text: Column) -> Column:
    """T5 on a whole text: drop ``</p>``-separated pieces holding a phrase."""
    pieces = F.split(text, "</p>", -1)
    return F.array_join(F.filter(pieces, lambda p: ~is_boilerplate(p)), "</p>")


def words(text: Column) -> Column:
    """Whitespace words (``str.split()``)."""
    t = F.trim(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def is_upper_word(w: Column) -> Column:
    """``str.isupper()``: has a cased letter and no lower-case one."""
    return (F.upper(w) == w) & (F.lower(w) != w)


def is_dateline(text: Column, countries: list[str] | None = None) -> Column:
    """T4 predicate: fewer than 6 words and an all-caps word or a country name."""
    ws = words(text)
    short = F.size(ws) < K.DATELINE_MAX_WORDS
    has_place = F.exists(ws, is_upper_word)
    if countries:
        padded = lambda t: F.concat(F.lit(" "), F.array_join(tokens(t), " "), F.lit(" "))
        names = F.transform(_lit_array(sorted({c.lower() for c in countries})), padded)    # "united kingdom" is two tokens
        has_place = has_place | F.exists(names, lambda n: (F.trim(n) != "") & F.contains(padded(text), n))
    return short & has_place


def tokens(text: Column, method: str = "regex") -> Column:
    """Runs of letters/digits of the lower-cased text, or whitespace words.

    Lower-casing the text once (not each token in an array lambda) keeps the
    work inside generated code.
    """
    if method == "whitespace":
        return words(text)
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), 0)


def content_words(toks: Column) -> Column:
    """Tokens without stop words and without punctuation runs."""
    punct = F.lit(K.PUNCTUATION)
    return F.filter(
        F.transform(toks, lambda t: F.lower(t)),
        lambda t: ~t.isin(K.STOPWORDS) & (F.instr(punct, t) == 0) & (t != ""),
    )


def display_text(text: Column) -> Column:
    """Accents to ASCII base letters, ``"`` -> ``''``, no ``<p>``/``</p>``, trimmed."""
    t = F.translate(text, K.ACCENTED_CHARS, K.ACCENT_BASES)
    t = F.replace(t, F.lit('"'), F.lit("''"))
    t = F.replace(F.replace(t, F.lit("<p>"), F.lit("")), F.lit("</p>"), F.lit(""))
    return F.trim(t)
