from pyspark.sql import functions as F

from conftest import articles_df, sentences_df
from revisionlens.operators import text as TX


def _clean(spark, s):
    return TX.clean_markup(articles_df(spark, [(1, 0, s)])).first()["summary"]


def test_clean_markup_lines(spark):
    page = ("<p><a href='x'>link</a></p><p>Version 3 of 7</p><p>Body &lt;b&gt;bold&lt;/b&gt; text.</p>"
            "<p>Currently monitoring 1,234 news articles</p>")
    # link line, version line and monitoring line go; escaped tags are deleted; outer <p> stripped
    assert _clean(spark, page) == "Body bold text."
    assert _clean(spark, "<p>One.</p><p>Two.</p>") == "One.</p><p>Two."
    assert _clean(spark, "Currently monitoring 12 news articles") == ""


def test_split_sentences_rule(spark):
    df = articles_df(spark, [(1, 0, "First one. Second one!</p><p>Third?\nFourth  "), (2, 0, "   ")])
    rows = TX.split_sentences(df).orderBy("entry_id", "sent_idx").collect()
    assert [r.sentence for r in rows] == ["First one.", "Second one!", "Third?", "Fourth"]
    assert [r.sent_idx for r in rows] == [0, 1, 2, 3]


def test_dateline_merge(spark):
    df = articles_df(spark, [(1, 0, "LONDON — First sentence. Second."), (2, 0, "Hello there. Bye now.")])
    rows = TX.split_sentences(df, merge_dateline=True).orderBy("entry_id", "sent_idx").collect()
    got = {(r.entry_id, r.sent_idx): r.sentence for r in rows}
    assert got[(1, 0)] == "LONDON—First sentence."
    assert got[(1, 1)] == "Second."
    assert got[(2, 0)] == "Hello there." and got[(2, 1)] == "Bye now."


def test_dateline_needs_dash_or_caps(spark):
    df = articles_df(spark, [(1, 0, "a short line. More text here.")])
    rows = TX.split_sentences(df, merge_dateline=True).collect()
    assert len(rows) == 2


def test_boilerplate_and_templates(spark):
    text = "Keep me. Share on Facebook now. The shop closed early. [Read more on it. Updated 5pm. Ends with]"
    df = articles_df(spark, [(1, 0, text)])
    kept = [r.sentence for r in TX.split_sentences(df, drop_boilerplate=True, drop_templates=True)
            .orderBy("sent_idx").collect()]
    # 'Close' is matched by containment, so "closed" goes too (kept on purpose)
    assert kept == ["Keep me."]


def test_tokens_content_words_display(spark):
    df = articles_df(spark, [(1, 0, 'The Café "opened" in 2021, again.')])
    s = TX.split_sentences(df)
    t = TX.content_words(TX.tokenize(s)).first()
    assert t.tokens == ["the", "café", "opened", "in", "2021", "again"]
    assert t.num_words == 6
    assert t.content_words == ["café", "opened", "2021"]
    d = TX.display_sentences(s).first().sentence
    assert d == "The Cafe ''opened'' in 2021, again."


def test_explode_tokens_word_idx_runs_over_document(spark):
    df = articles_df(spark, [(1, 0, "a b c. d e.")])
    rows = TX.explode_tokens(TX.split_sentences(df)).orderBy("word_idx").collect()
    assert [(r.sent_idx, r.word_idx, r.token, r.num_words) for r in rows] == [
        (0, 0, "a", 3), (0, 1, "b", 3), (0, 2, "c", 3), (1, 3, "d", 2), (1, 4, "e", 2)]


def test_lemmas_keep_wordless_and_equal_rows(spark):
    s = sentences_df(spark, [(1, 0, ["Dogs barked.", "The.", "Dogs barked."])]).drop("sent_idx")
    lemmas = spark.createDataFrame([("dogs", "dog"), ("dogs", "dog")], "word string, lemma string")
    rows = [r.content_words for r in TX.content_words(s, lemmas).collect()]
    assert sorted(rows) == [[], ["dog", "barked"], ["dog", "barked"]]


def test_dateline_of_a_country_of_two_words(spark):
    df = articles_df(spark, [(1, 0, "United Kingdom — The bridge opened. It rained."), (2, 0, "A kingdom united — The bridge opened. It rained.")])
    rows = TX.split_sentences(df, merge_dateline=True, countries=["United Kingdom", ""]).orderBy("entry_id", "sent_idx").collect()
    first = {r.entry_id: r.sentence for r in rows if r.sent_idx == 0}
    assert first[1].startswith("United Kingdom") and first[1].endswith("The bridge opened.")
    assert [r.sent_idx for r in rows if r.entry_id == 1] == [0, 1]


def test_lemmas_without_copies_of_the_word_lists(spark):
    import contextlib
    import io
    s = sentences_df(spark, [(1, 0, ["Dogs barked.", "The.", "Dogs barked.", "Cats sat; dogs ran."])])
    s = s.unionByName(spark.createDataFrame([(None, None, None, None, None)], s.schema)).unionByName(s.limit(1))
    lemmas = spark.createDataFrame([("dogs", "Dog"), ("cats", "the"), ("ran", None), ("none", "nothing")], "word string, lemma string")
    out = TX.content_words(s, lemmas)
    assert out.columns == [*s.columns, "content_words"]
    assert sorted((r.content_words is None, r.content_words or []) for r in out.collect()) == [
        (False, []), (False, ["dog", "barked"]), (False, ["dog", "barked"]), (False, ["dog", "barked"]), (False, ["sat", "dog", "ran"]), (True, [])]
    no_lemmas = TX.content_words(s, lemmas.limit(0)).collect()
    assert sorted(map(str, no_lemmas)) == sorted(map(str, TX.content_words(s).collect()))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain("formatted")
    assert "collect_list" not in buf.getvalue()                 # lists aren't taken apart with a copy for each of their words
