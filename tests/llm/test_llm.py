"""The ten operators and the pipeline on small fixtures: brute force, odd input, round trips."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revisionlens.llm import components, decontam, htmltext, kneserney, licenses, linededup, mixing, neardup, rules, tokens, urls
from revisionlens.llm.queries import ORACLE, QUERIES
from revisionlens.session import recorded_tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, n string, size string"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, near copies, repeated lines."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, line = prose(120), "A line that many documents share, at length"
    rows = [(i, prose(rng.randint(1, 90)) + f"\n{line}\n" + prose(30), "en", f"s{i % 4}") for i in range(40)]
    for i in range(40, 60):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s1"))
    rows += [(60, base, None, None), (61, base.upper(), "de", "s0"), (62, None, None, "s9"), (63, "", "", ""), (64, "one two", "en", "s2"), (65, "ONE two", "en", "s2"),
             (66, " \t\n ", "en", "s2"), (67, prose(20_000), "en", "s3"), (None, prose(60), "en", "s3"), (None, None, None, None), (68, "É é é É ÀÉ " * 8, "fr", "s1"), (64, "one two", "en", "s2")]
    return [(d, t, l, s, len(t or ""), "k", "r", "n", "z") for d, t, l, s in rows]


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


def got(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            w = words(lower(t or ""))
            sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_equal_brute_force(docs, odd_rows):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(odd_rows)
    want = brute_components(odd_rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with other texts unite what each is linked with; null ids link nothing."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40))
    one, two, three = text(), text(), text()
    rows = [(1, one), (2, two), (5, one), (5, two), (5, ""), (7, three), (8, three + " more"), (9, text()), (None, one), (8, text()), (9, None), (1, one)]
    out = neardup.near_duplicates(spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, component int, row int"))
    sizes = [max(0, len((t or "").split()) - 4) for _, t in rows]
    component = {1: 1, 2: 1, 5: 1, 7: 7, 8: 7, 9: 9, None: None}
    want = [(d, n, component[d], d is None or component[d] == d) for (d, _), n in zip(rows, sizes, strict=True)]
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_duplicates_large_group_in_tiles(spark):
    """A bucket of more than a tile, where most are linked only by way of others."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == want


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 2 ** 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for share in (0.5, 0.8):
        y = np.sort(np.concatenate([x[:int(4000 * share)], rng.integers(0, 2 ** 63, 4000 - int(4000 * share), dtype=np.uint64)]))
        true = share / (2 - share)
        a, b = neardup.registers(np.unique(x)), neardup.registers(np.unique(y))
        est = neardup.estimated(np.array([(a == b).sum()]), np.array([4000.0]), np.array([4000.0]))[0]
        assert abs(est - true) < 0.15


def test_components_of_a_long_path_and_nulls(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (None, 3), (70, 60), (60, 70)], "a long, b long")
    assert {r.id: r.component for r in components.components(e).collect()} == {**{i: 0 for i in range(1, 41)}, 70: 60}
    assert components.components(e.limit(0)).count() == 0


@pytest.mark.parametrize(("edges", "want", "tables"), [
    ([(1, 9), (9, 2), (9, 1)], {2: 1, 9: 1}, None),              # a larger end with two edges
    ([(1, 2), (2, 3), (4, 5)], {2: 1, 3: 1, 5: 4}, None),        # an end that is larger and smaller
    ([(1, i) for i in range(2, 40)] + [(50, 60), (60, 50), (7, 7), (None, 8)], {**{i: 1 for i in range(2, 40)}, 60: 50}, 1),
    ([], {}, 1)])
def test_components_take_no_round_once_they_are_stars(spark, edges, want, tables):
    with recorded_tables() as made:
        found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == want
    assert tables is None or len(made) == tables


@pytest.mark.parametrize("repeated", [False, True])
def test_near_duplicates_merges_wide_rows_only_where_ids_repeat(spark, monkeypatch, repeated):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i % 20], f"x{rng.randrange(10 ** 6)}", *base[i % 20:]])) for i in range(80)] + [(90, "one two"), (91, None)]
    rows += rows[3:9] * repeated
    docs, merged = spark.createDataFrame(rows, "doc_id long, text string"), []
    kind = type(docs)
    drop = kind.dropDuplicates
    monkeypatch.setattr(kind, "dropDuplicates", lambda self, *a: merged.append(a) or drop(self, *a))
    out = neardup.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter((d, *want[d]) for d, _ in rows)
    assert bool(merged) == repeated


def test_tokens_round_trip(spark, docs, odd_rows, tmp_path):
    from tokenizers import Tokenizer
    extra = docs.unionByName(spark.createDataFrame([(900, "a <|endoftext|> B<|ENDOFTEXT|> ΣΑΣ. don't, 12 ...x., ́e", None, None, 0, "", "", "", "")], DOCS))
    out = sorted(tokens.tokenized(extra).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    rows = sorted([(r.doc_id, r.text or "") for r in extra.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert [r.doc_id for r in out] == [r[0] for r in rows]
    for r, (_, text) in zip(out, rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        if r.doc_id is not None:
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r.n_tokens
    folder = str(tmp_path / "ids")
    tokens.write_tokens(docs, folder)
    assert tokens.read_tokens(spark, folder).filter("doc_id = 64").count() == 2
    tokens.write_tokens(docs.limit(0), folder)
    assert tokens.read_tokens(spark, folder).count() == 0


def test_token_pieces_are_bounded(monkeypatch):
    e = tokens.Encoder(tokens.tokenizer_path())
    text = "Some words, and then. some WORDS and Others, again."
    want = [*e.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert e.encode([text])[0].tolist() == want
    assert e._by_pieces([text.lower()])[0].tolist() == want[:-1]
    monkeypatch.setattr(tokens, "LONG_PIECE", 4)             # longer pieces are left to the library
    assert e._by_pieces(["", text.lower(), "a b, c."])[1] is None
    assert e.encode(["", text, "a b"])[1].tolist() == want


def test_ids_are_exact_for_words_and_short_forms():
    """Vocabulary entries joined and cut at random, and every apostrophe form, have the library's ids."""
    import json
    rng = random.Random(11)
    e = tokens.Encoder(tokens.tokenizer_path())
    entries = [t.removesuffix(tokens.SUFFIX) for t in json.loads(e.tokenizer.to_str())["model"]["vocab"]]
    plain = [t for t in entries if t.isascii() and t.isalpha()]
    made = [rng.choice(plain) + rng.choice(plain)[:rng.randint(0, 9)] for _ in range(30_000)]
    forms = ["".join(rng.choice(["'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "a", "s", "!", "1", " ", "|", "re", "中", "É"]) for _ in range(rng.randint(1, 8))) for _ in range(6000)]
    texts = [" ".join(made[i:i + 50]) for i in range(0, len(made), 50)] + forms + ["x" * 9000, "'", "''s", "a\U0001f600b", "\u3000中 文,。"]
    for t, ids, want in zip(texts, e.encode(texts), e.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == [*want.ids, 1], t


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>menu menu menu</nav><div class="cookie-notice">We use cookies here</div>
<div id="with-sidebar"><div class="sidebar"><p>words in the sidebar, quite a few more than you may think</p></div>%s<section id="comments"><p>A reader says a lot about it</p></section></div><footer>f</footer></body>"""
ARTICLE = "<h1>Title &amp; more</h1><p>First&nbsp;paragraph, <b>bo</b>ld\n\n text<br>goes <!-- a > b --> on here.<p>Ok.</p><form>sign up</form><script>var x = '</p>';</script><ul><li>one<li>two</ul>"
TEXT = "Title & more\nFirst paragraph, bold text goes on here.\nOk.\none\ntwo"


def test_html_text(spark):
    rows = [(1, "u", PAGE % f"<article>{ARTICLE}</article>"), (2, "u", PAGE % f"<div class='post'>{ARTICLE}</div>"), (3, None, None), (4, "", ""), (5, "u", "<p>a < b and &am; c"),
            (6, "u", "<article><p>Be.</article>"), (None, None, "<<<>>><p"), (7, "u", "<div class='widget'><p>only this</p></div>"), (1, "u", PAGE % f"<article>{ARTICLE}</article>")]
    rows = [(*r, "x") for r in rows]
    out = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text == TEXT and by[1].n_chars == len(TEXT)
    assert by[2].text == TEXT
    assert by[3].text == by[4].text == "" and by[5].text == "a < b and &am; c" and by[6].text == "Be." and by[7].text == "only this"


def test_article_in_a_form():
    weights = htmltext.DEFAULT_WEIGHTS
    inner = ARTICLE.replace("<form>sign up</form>", "<div class='signup'>sign up</div>")
    body = inner.replace("on here.", "on here, and for quite a few more words than the menu has.")
    for tag in ("form id='form1'", "dialog open", "object"):
        end = tag.split()[0]
        page = f"<html><head><title>t</title></head><body><nav>menu menu menu</nav><{tag}><input type=hidden>%s</{end}><form>search <b>this</b> site</form></body>"
        assert htmltext.main_text(page % f"<div class='menu'>more menu</div><article>{inner}</article>", weights) == TEXT
        assert htmltext.main_text(page % f"<div>{body}</div>", weights) == TEXT.replace("on here.", "on here, and for quite a few more words than the menu has.")
    assert htmltext.main_text("<article><p>Be here.</p><form>sign up now or later, as you like it</form></article>", weights) == "Be here."


def test_nothing_but_marks_is_removed_in_an_article():
    page = """<body><nav>m</nav><article><p>One two three four.</p><section class="search-results-explained"><p>five six seven</p></section>
<div class="related-note">eight</div><div class="related-posts">gone</div><div class="inline-ad-300x250">gone</div><ul id="readerComments"><li>gone</ul></article>
<article><p>Second.</p></article><article class="comment"><p>gone</p></article><section class="more"><article><p>Teaser.</p></article></section></body>"""
    assert htmltext.main_text(page, htmltext.DEFAULT_WEIGHTS) == "One two three four.\nfive six seven\neight\nSecond."
    whole = "<body><div class='my-search-story'><p>One two three four.</p><p>more</p></div><div class='footer-x'>at the foot</div></body>"
    assert htmltext.main_text(whole, htmltext.DEFAULT_WEIGHTS) == "One two three four.\nmore"


def test_unclosed_tags_take_linear_time():
    for tag in ("<span>", "<div>", "<p>x<b>", "<li><i>", "<article>", "</x><a href=\"", "<div class='related-note'>w "):
        began = time.process_time()
        htmltext.main_text("<body>" + tag * 100_000 + "word word", htmltext.DEFAULT_WEIGHTS)
        assert time.process_time() - began < 5


def test_html_of_empty_tables_and_long_pages(spark):
    schema = "page_id long, url string, html string, dropped int, kind int"
    assert htmltext.extract_text(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"word{i}" for i in range(300_000))
    out = htmltext.extract_text(spark.createDataFrame([(1, None, f"<nav>m</nav><article><p>{long}</p></article>", 1, 2)], schema)).collect()
    assert out[0].text == long and out[0].n_chars == len(long)


def test_best_run():
    assert htmltext.best_run([-1, 2, -1, 3, -9, 4]) == (1, 3) and htmltext.best_run([-1, 0]) == (0, -1)


def test_line_dedup_brute_force(docs, odd_rows):
    out = linededup.dedup_lines(docs).collect()
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t, *_ in odd_rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d)
    want = Counter()
    for d, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != d)]
        want[(d, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter(tuple(r) for r in out) == want
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_mix(docs, odd_rows):
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(odd_rows)
    total = sum(r.size for r in out)
    sources = {r.source: (r.source_size, r.target) for r in out}
    assert sum(t for _, t in sources.values()) == pytest.approx(total)
    for s, (size, target) in sources.items():
        taken, largest = sum(r.taken for r in out if r.source == s), max(r.size for r in out if r.source == s)
        assert target <= 3 * size and abs(taken - target) <= largest
    assert all(0 <= r.copies <= 3 for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in out)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_url_branches_speak_for_unlabelled_templates(spark):
    """A path branch with enough labels decides its unlabelled children; a host's other branches don't; a very long path costs no rounds."""
    labelled = [(f"http://h.xyz/shop/{'ab'[i % 2]}{x}/p", 1) for i, x in enumerate("qrstuvwxyz" * 3)] + [("http://h.xyz/news/a/p", 0)] * 30
    asked = ["http://h.xyz/shop/other/p/q", "http://h.xyz/fresh/a/p", "http://h.xyz/news/c/p", "http://new.xyz/shop/other", "http://h.xyz/" + "deep/" * 2000, "http://h.xyz/shop/aq/p"]
    out = got(urls.filter_urls(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), spark.createDataFrame(labelled, "url string, blocked int")), "page_id")
    assert [out[i].verdict for i in range(len(asked))] == ["block", "allow", "allow", "allow", "allow", "block"]
    empty = urls.filter_urls(spark.createDataFrame([], "page_id long, url string"))
    assert empty.count() == 0
    twice = urls.filter_urls(spark.createDataFrame([(1, asked[0]), (1, asked[0]), (None, None)], "page_id long, url string")).collect()
    assert len(twice) == 3 and {r.verdict for r in twice} == {"allow"}


def test_url_rules(spark):
    rows = [("http://com/", "com/", "allow"), ("HTTP://WWW.Example.COM/en/a", "www.example.com/en/", "allow"), ("x://a.example.com/en/", "example.com/en/", "block"),
            ("http://example.com/en", "com/", "allow"), ("https://x.net/es/1?q#z", "net/es/", "block"), ("net/es/", None, "allow"), (None, None, "allow"), ("http://net", None, "allow"), ("", None, "allow")]
    out = got(urls.filter_urls(spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host string")), "page_id")
    assert [(out[i].rule, out[i].verdict) for i in range(len(rows))] == [(r, v) for _, r, v in rows]
    assert (out[1].host, out[1].path, out[6].host, out[6].path) == ("www.example.com", "/en/a", "", "")


def test_url_templates_use_labels(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(f"http://a.org/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(0, 200, 3)], "url string, blocked int")
    out = urls.filter_urls(pages, labels).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out)


def test_url_templates_of_deep_paths(spark):
    url = lambda i: f"http://a.org/a/b/c/d/{'bad' if i % 2 else 'good'}/{i}"
    pages = spark.createDataFrame([(i, url(i)) for i in range(200)] + [(200, "http://a.org/a/b"), (201, "http://a.org/a/b/c/d"), (202, None)], "page_id long, url string")
    labels = spark.createDataFrame([(url(i), i % 2) for i in range(0, 200, 3)], "url string, blocked int")
    out = urls.filter_urls(pages, labels).collect()
    assert len(out) == 203 and all(r.template is not None for r in out)
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out if r.page_id < 200)


def brute_hits(rows, items):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    out = Counter()
    for d, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            size = min(13, len(v))
            for j in range(len(v) - size + 1) if item is not None and v else ():
                for k in range(len(w) - size + 1):
                    if w[k:k + size] == v[j:j + size]:
                        hit.update(range(k, k + size))
                        found.add(str(item))
        out[(d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontamination_brute_force(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] != 67]
    source = " ".join(rows[3][1].split())
    items = [(1, " ".join(source.split()[:20])), (10, "one, TWO"), (2, "É É"), (3, None), (4, ""), (None, "one two"), (5, "never seen at all"), (6, rows[45][1]), (1, "é é é")]
    rows += [(200, source + " tail " + source, "en", "s", 0, "k", "r", "n", "z")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    out = decontam.contamination(spark.createDataFrame(rows, DOCS), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out) == brute_hits(rows, items)
    none = decontam.contamination(spark.createDataFrame(rows, DOCS), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_decontamination_of_null_ids(spark):
    whole = " ".join(f"w{i}" for i in range(20))
    rows = [(None, whole), (None, f"tail {whole} tail"), (None, "w1 w2 w3"), (None, None), (1, whole), (None, whole)]
    items = [(1, whole), (2, "tail w0")]
    found = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()) == brute_hits(rows, items)


def test_proximity(spark):
    items = decontam._items(spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 200 + "beta"), (3, "x")], "doc_id long, text string")
    postings, anchors = decontam.build_index(docs, items)
    near = decontam.proximity_matches(postings, anchors, items, distance=20, least=2)
    assert [(r.doc_id, r.item_id) for r in near.collect()] in ([], [(1, 1)])          # both terms are anchors only if they are the rarest


def test_proximity_of_reworded_short_items(spark):
    items = [(1, "the quick zebra of the north eats purple lemons at dawn"), (2, "rare pair"), (3, "never seen")]
    far = "x " * 60
    rows = [(1, f"{far} at dawn the zebra from the north was eating lemons {far}"), (None, "a pair is rare"), (2, f"zebra {far} lemons {far} north {far} purple {far} pair"),
            (3, "the of at " * 5), (4, "zebra " + "x " * 24 + "lemons " + "x " * 24 + "purple"), (5, "zebra " + "x " * 24 + "lemons " + "x " * 25 + "purple"), (6, items[0][1]), (7, None), (8, "rare " + far)]
    rows += [(100 + i, "the of at eats quick") for i in range(30)]
    out = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    near = {r.doc_id: (r["near_items"], r.near_terms >= 2, r.contaminated) for r in out if r["near_items"]}
    assert near == {1: (["1"], True, False), None: (["2"], True, False), 4: (["1"], True, False), 6: (["1"], True, True)}


def test_kneser_ney_scores(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(["the", "words", "are", "plain", "and", "good"]) for _ in range(80)), "en") for i in range(120)]
    junk = [(500 + i, "".join(rng.choice("#%&$|!XQZ") for _ in range(300)), "en") for i in range(10)]
    rows = [*clean, *junk, (900, None, None), (901, "", "en"), (902, "the words", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, nll string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(500, 0, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    whole = got(kneserney.quality_scores(docs, labels), "doc_id")
    assert all(whole[i].kept for i, *_ in clean) and not any(whole[i].kept for i, *_ in junk) and whole[900].kept and whole[900].perplexity is None
    shards = got(kneserney.quality_scores(docs, labels, model_entries=0), "doc_id")
    assert all(shards[k].kept == whole[k].kept and (shards[k].score is None or abs(shards[k].score - whole[k].score) < 1e-9) for k in whole)
    assert all(r.kept for r in kneserney.quality_scores(docs, labels.limit(0)).collect())
    assert kneserney.quality_scores(docs.limit(0), labels).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abracadabra alakazam",), ("abba cadabra",)], "text string")
    m = kneserney.train(docs).toPandas()
    model = {k: kneserney.Lookup(g.key.to_numpy(), g.value.to_numpy()) for k, g in m.groupby("kind")}
    for context in ("abra", "zzzz", "b ca"):
        h = 0
        for c in context:
            h = (h << kneserney.BITS) | ord(c)
        p = np.exp(kneserney.log_probabilities((np.int64(h) << kneserney.BITS) | np.arange(1 << kneserney.BITS), model)).sum()
        assert abs(p - 1) < 1e-9


def brute_kneser_ney(trusted, text):
    """-log of a text's probability: the formula over tuples of bytes, order by order."""
    grams = lambda t: [tuple((b"\xff" * 4 + t.encode())[i:i + 5]) for i in range(len(t.encode()))]
    counts = {5: Counter(g for t in trusted for g in grams(t))}
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, left = {}, {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        for g, v in c.items():
            i = min(v, 3)
            off[g] = min(min(max(d[i], 0.05), i), 0.95 * v)
            total[g[:-1]] = total.get(g[:-1], 0) + v
            left[g[:-1]] = left.get(g[:-1], 0) + off[g]

    def p(g):
        if not g:
            return 1 / 256
        if g[:-1] not in total:
            return p(g[1:])
        c = counts[len(g)].get(g, 0)
        return (c - off[g] if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])
    return -sum(np.log(p(g)) for g in grams(text))


def test_kneser_ney_brute_force(spark):
    trusted = ["abracadabra alakazam", "abba cadabra", "\u4e2d\u6587\u6587\u672c and \u201cquotes\u201d \u2014 \ud55c\uad6d\uc5b4", "a" * 40 + "b" * 9, ""]
    texts = [*trusted, "\u4e2d\u6587", "\u4f2d\u6587", "zebra \U0001f600", "\x02\x02", "abra"]
    docs = spark.createDataFrame([(i, "l", t, i) for i, t in enumerate(texts)], "doc_id long, lang string, text string, row_id long")
    model = kneserney.train(docs.filter(f"doc_id < {len(trusted)}").select("text"))
    want = [brute_kneser_ney(trusted, t) for t in texts]
    for entries in (kneserney.MODEL_ENTRIES, 0):
        rows = got(kneserney.score(docs, model, entries), "doc_id")
        assert all(abs(rows[i].nll - w) < 1e-6 * max(1, w) and rows[i].n_chars == len(texts[i]) for i, w in enumerate(want))
    assert want[texts.index("\u4f2d\u6587")] > want[texts.index("\u4e2d\u6587")]


def test_quality_rules_brute_force(docs, odd_rows):
    out = Counter(tuple(r)[:7] for r in rules.quality_rules(docs).collect())
    want = Counter()
    for d, t, *_ in odd_rows:
        t, w = t or "", words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        cover = {k + i for k in range(len(w) - 2) for i in range(3) if grams[tuple(w[k:k + 3])] > 1}
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert out == want
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_cascade_verdict_does_not_depend_on_order(odd_rows):
    import pyarrow as pa
    from revisionlens.llm.textbatch import chunks
    texts = pa.array([r[1] for r in odd_rows] + ["# " * 60, "A" * 500 + " B" * 60, "1 " * 70])
    names = [r.name for r in rules.RULES]
    for _, _, t in chunks(texts):
        alive = np.ones(t.rows, bool)
        assert (rules.cascade(t, alive, names)[0] == rules.cascade(t, alive, names[::-1])[0]).all()


def test_rule_order_is_the_same_in_every_run(spark, docs):
    orders = {tuple(rules.rule_order(docs.repartition(n).select("doc_id", "text"))) for n in (1, 2, 5)}
    assert len(orders) == 1
    by = [sorted((str(r.doc_id), str(r.rejected_by)) for r in rules.quality_rules(docs.repartition(n)).collect()) for n in (2, 4)]
    assert by[0] == by[1]


def test_rules_reject_what_each_says(spark):
    """Each rule by itself, against its words in plain Python."""
    prose = "some plain words of a text that goes on " * 8
    rows = [prose, "# * | " * 40 + prose[:150], "a " * 60, ("the same line again of ten plain words in it\n" * 9), prose.upper(), "12345 678 90 " * 30, "·— … ¿? " * 40, prose + "é" * 30]
    n = lambda pattern, s: len(re.findall(pattern, s))

    def fails(s):
        w, lines = words(s), [x for x in s.split("\n") if words(x)]
        chars = sum(map(len, w))
        return [2 * n(r"[#*$%&|<>]", s) > len(w), chars < 2 * len(w) or chars > 25 * len(w), 2 * (len(lines) - len(set(lines))) > len(lines),
                2 * n("[A-Z]", s) > n("[A-Za-z]", s) + n("[é¿·—…]", s), 2 * n("[0-9]", s) > chars]
    texts = next(t for _, _, t in rules.chunks(rules.pa.array(rows)))
    got_ = [r.fails(rules.Stats(texts)).astype(bool).tolist() for r in rules.RULES[:5]]
    assert got_[:3] == [list(x) for x in zip(*(fails(s)[:3] for s in rows), strict=True)] and got_[4] == [fails(s)[4] for s in rows]
    assert got_[3][4] and not got_[3][0]


def test_licenses(spark):
    filler = "word " * 400
    rows = [(1, f"{filler}\nReleased under the MIT License.\n{filler}the under released"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "the license is under review"), (None, ""),
            (5, filler + licenses.TEMPLATES["GPL-3.0"].replace("General ", "general, ") + "\n" + licenses.TEMPLATES["GPL-3.0"])]
    out = {(r.doc_id, r.license) for r in licenses.license_matches(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")).collect()}
    assert out == {(1, "MIT"), (2, "CC-BY-NC-4.0"), (5, "GPL-3.0")}
    assert licenses.aligned("a x b c d".split(), "a b c y d".split()) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    for _ in range(200):
        a, b = ([random.choice("abcdefgh") for _ in range(random.randint(0, 12))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_license_share_of_four_in_five_and_adjacent_copies():
    filler, notice = "word " * 400, licenses.TEMPLATES["MIT"]
    assert [h[:2] for h in licenses.scan(f"{filler}\nLicensed under the MIT License.\n{filler}")] == [("MIT", 0.8)]
    assert licenses.scan(f"{filler}{notice} {notice} {filler}") == [("MIT", 1.0, 400, 404)]
    for name, text in licenses.TEMPLATES.items():
        assert (name, 1.0) in [h[:2] for h in licenses.scan(f"{filler}{text} {text} {text}")]


def test_licenses_are_told_apart(spark):
    found = lambda text: {h[0] for h in licenses.scan("word " * 50 + text + " word" * 50)}
    for text, name in [("licensed under the GNU General Public License, version 2", "GPL-2.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
                       ("Licensed under CC BY-NC-ND 3.0.", "CC-BY-NC-ND-3.0"), ("Licensed under CC BY 2.5.", "CC-BY-2.5"), ("Licensed under the ISC License", "ISC"),
                       ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("Released under the BSD License.", None)]:
        assert found("This work is " + text if text.startswith("licensed") else text) == ({name} - {None}), text
    for name, texts in licenses.DEFAULT.items():
        for text in texts:
            assert name in found(text), name
    for name, text in licenses.TEXTS.items():
        w = text.split()
        del w[100::50]
        assert found(" ".join(w)) & set(licenses.TEXTS) == {name}, name
    assert "BSD-3-Clause" not in found(licenses.PHRASINGS["BSD-2-Clause"][0]) and "BSD-2-Clause" not in found(licenses.PHRASINGS["BSD-3-Clause"][0])
    assert "ISC" not in found(licenses.PHRASINGS["0BSD"][0]) and "0BSD" not in found(licenses.PHRASINGS["ISC"][0])
    own = licenses.license_matches(spark.createDataFrame([(1, "all of this is ours"), (2, "Released under the MIT License.")], "doc_id long, text string"), {"ours": "this is ours", "no": ("", ".")})
    assert [(r.doc_id, r.license) for r in own.collect()] == [(1, "ours")]


def test_license_windows_count_like_multisets():
    rng = random.Random(4)
    text, part = [rng.choice("abcde") for _ in range(300)], Counter("aabbbd")
    window, lo, hi = licenses._Window(text, part), 0, 0
    for _ in range(60):
        lo, hi = lo + rng.randint(0, 9), max(hi, lo + 9) + rng.randint(0, 9)
        assert window.moved(lo - 3, hi) == (Counter(text[max(lo - 3, 0):hi]) & part).total()


def test_licenses_of_empty_tables_and_repeated_copies(spark):
    assert licenses.license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    mit = licenses.PHRASINGS["MIT"][0].split()
    altered = " ".join(w for k, w in enumerate(mit) if k % 31)
    once, often = licenses.scan(altered), licenses.scan(" ".join([altered] * 40))
    share = lambda found: max(x[1] for x in found if x[0] == "MIT")
    assert licenses.COVERAGE <= share(once) <= share(often) < 1           # a place may take a lacking word from the next copy


def test_queries_are_registered():
    assert sorted(QUERIES) == sorted(set(QUERIES)) and {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(i) for i in range(1, 14)} and set(ORACLE) <= set(QUERIES)


def test_pipeline(spark, odd_rows, tmp_path):
    import corpus_pipeline
    small = [r for r in odd_rows if r[0] is not None and r[0] < 66]
    d = str(tmp_path)
    spark.createDataFrame(small, DOCS).drop("key", "row", "n", "size").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(small[3][1].split()[:40]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, d)
    want = brute_components(small)
    assert {r.doc_id for r in near.collect()} == {k for k, (_, c) in want.items() if k == c}
    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, d).collect()}
    assert 3 not in clean and len(clean) >= 60
    out = corpus_pipeline.run(spark, d).orderBy("start").collect()
    starts = 0
    for r in out:
        assert r.start == starts
        starts += r.n_tokens
    assert {r.doc_id for r in out} <= {k for k, (_, c) in want.items() if k == c} - {3} and len(out) > 20


def test_pipeline_judges_rows(spark, tmp_path):
    """Null and repeated ids: each row is judged by its own text, and one of equal rows stays."""
    import corpus_pipeline
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "words", "are", "plain", "and", "good"]) for _ in range(n))
    junk = ["".join(rng.choice("#%&$|!XQZ") for _ in range(300)) for _ in range(2)]
    item, copy = " ".join(f"w{i}" for i in range(20)), prose(60)
    d = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    held = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    docs = lambda rows: spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    clean = [(i, prose(60)) for i in range(80)]
    assert held(corpus_pipeline.quality(spark, docs([*clean, (None, junk[0]), (None, clean[3][1]), (90, junk[1]), (90, clean[4][1])]), d)) == Counter([*clean, (None, clean[3][1]), (90, clean[4][1])])
    assert held(corpus_pipeline.decontaminate(spark, docs([*clean, (None, item), (None, "w1"), (90, item), (90, "w2")]), d)) == Counter([*clean, (None, "w1"), (90, "w2")])
    few = [(5, copy), (5, copy), (None, copy), (4, copy), (6, prose(70)), (6, copy), (7, None), (7, None), (None, None), (None, None)]
    assert held(corpus_pipeline.near_dedup(spark, docs(few), d)) == Counter([(4, copy), few[4], (7, None), (None, None), (None, None)])


def test_pipeline_mix_takes_the_labels(spark, tmp_path):
    import corpus_pipeline
    once = spark.createDataFrame([(i, f"word {i} " * 5, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i // 3 % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    counted = lambda rows: Counter({r.doc_id: r.copies for r in rows.collect() if r.copies})
    taken = Counter(r.doc_id for r in corpus_pipeline.mix(spark, once, str(tmp_path)).collect())
    assert taken == counted(mixing.mix_documents(once, labels)) != counted(mixing.mix_documents(once))
    low = [i for i in taken if i % 3 == 0 and i // 3 % 2 == 0]
    assert 2 * len(low) < len([i for i in taken if i % 3 == 0]) < 100


def test_pieces_have_the_ids_of_the_whole_text():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from revisionlens.llm import tokens
    whole, encoder = Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    assert encoder.piecewise
    rnd = random.Random(7)
    letters = "aábcdeEÉßµªİıΣσςʹͅжЖЙйǅŉ中文ﬁ" + "́̈ͅ" + "0129²½" + ".,!?'-_" + "  \u0085\t\x1c" + "    \n\n"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    latin = "abcZÉßµª_0²½" + "..,,!?'-" + "  \u0085\xa0\t\n"
    texts += ["".join(rnd.choice(latin) for _ in range(rnd.randrange(30))) for _ in range(6000)]
    texts += ["it's. He'll, we've", "a.. b., c.,", "Straße. ÉTÉ, naïve", "<|endoftext|> x", ""]
    found = encoder.encode(texts)
    for t, ids in zip(texts, found, strict=True):
        assert np.array_equal(ids, [*whole.encode(t, add_special_tokens=False).ids, tokens.END_ID]), t
    encoder.piecewise = False
    assert all(np.array_equal(a, b) for a, b in zip(found, encoder.encode(texts), strict=True))
