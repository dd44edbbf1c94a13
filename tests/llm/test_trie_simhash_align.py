"""Operators 11 to 13: brute force, odd input, small shards and tiles."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from revisionlens.llm import prefixtrie, simhash, tokenalign

CLASH = ", key string, row string, fp string, pair string, cell string, path string, depth string"
EXTRA = ("k", "r", "f", "p", "c", "q", "d")


# ------------------------------------------------------------------ 11
def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    below = {}
    for k in nodes:
        if k:
            below.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in below.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(below.get(k, [])), leaves[k], saved[k], sha([c for c in m if len(made[c]) == len(k)]))
                  for k, m in nodes.items())


def trie_rows():
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(rnd.randrange(0, 14)):
            rows.append((c if rnd.random() < .98 else None, rnd.choice([t, t, t, None]), rnd.choice(["u", "a", None]), rnd.choice(["hi", "", "ß", None])))
    rows += [(c, t, "u", "same") for c in range(200, 260) for t in range(12)]                                     # one conversation many times
    rows += [(c, t, "u", f"x{t if t < 90 or c % 2 else c}") for c in range(300, 306) for t in range(130 + c % 7)]    # longer than one block of columns
    return rows + [(-1, 0, "u", "neg"), (-5, 0, "u", "n5"), (-5, 1, "u", "n6"), (-5, 1, "u", "n6")]


@pytest.mark.parametrize("shard_turns", [1 << 20, 90])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", shard_turns)
    rows = trie_rows()
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], "conv_id long, turn long, role string, text string" + CLASH)
    out = prefixtrie.conversation_trie(df)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in out.collect()) == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(7, None, None, None), (None, 0, "u", "x")]
    out = prefixtrie.conversation_trie(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in out) == brute_trie(rows)


def test_rows_are_sorted_by_sequence():
    rnd = random.Random(3)
    seqs = [[rnd.randrange(3) for _ in range(rnd.choice([0, 1, 5, 70, 140]))] for _ in range(80)]
    seqs += [seqs[3], seqs[4] + [0], seqs[4]]
    size = np.array([len(s) for s in seqs])
    start = np.cumsum(size) - size
    order = prefixtrie.ordered(np.array([x for s in seqs for x in s]), start, size, np.arange(len(seqs)))
    assert order.tolist() == sorted(range(len(seqs)), key=lambda i: (seqs[i], i))


# ------------------------------------------------------------------ 12
def brute_fingerprint(text):
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components_of(pairs, ids):
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def test_simhash_groups_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = prose(300)
    rows = [(i, prose(rnd.randint(1, 60))) for i in range(30)] + [(30 + i, base.replace(vocab[i], "zz", 1)) for i in range(40)]
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "one"), (84, "ONE"), (85, "one two"), (86, "É é x"), (None, base), (None, None),
             (90, rows[0][1]), (90, rows[1][1]), (91, rows[2][1]), (91, rows[2][1]), (92, prose(40_000))]
    df = spark.createDataFrame([(d, t, *EXTRA) for d, t in rows], "doc_id long, text string" + CLASH).repartition(3)
    out = simhash.simhash_groups(df).collect()
    assert len(out) == len(rows)
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    known = [(d, f) for d, f in fps if d is not None]
    want = components_of([(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 2], {d for d, _ in known})
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(d), f"{f:016x}") for d, f in fps)
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in out)
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_of_crowded_cells(spark):
    """Fingerprints a few bits apart in small tiles: the components are those of all pairs within the radius."""
    rnd = random.Random(9)
    fps = set()
    for _ in range(3):
        center = rnd.getrandbits(64)
        fps |= {center ^ sum(1 << rnd.randrange(64) for _ in range(rnd.choice([0, 1, 1, 2, 4]))) & (2 ** 64 - 1) for _ in range(60)}
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    simhash.prepare(spark)
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=5).collect()
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2]
    assert components_of([(r.a, r.b) for r in got], signed) == components_of(pairs, signed)


# ------------------------------------------------------------------ 13
def brute_align(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs, counts = [], Counter()
    for d, t in rows:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        x = [bytes(of[c] for c in whole.id_to_token(i)) for i in a]
        y = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append((d, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(z) for z in x]).tolist(), np.cumsum([len(z) for z in y]).tolist()
        groups, ia, ib = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            ja, jb = ea.index(e) + 1, eb.index(e) + 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if (ea[i - 1] if i else 0) < eb[j] and (eb[j - 1] if j else 0) < ea[i]]
        counts.update(set(links))
        docs.append((d, a, b, groups, links))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    text = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return [(d, len(a), len(b), len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(text(g).encode()).hexdigest() if a else "")
            for d, a, b, g, k in docs]


def test_align_tokens_equals_brute_force(spark):
    rnd = random.Random(6)
    letters = "abc de fghiABC.,!?'0123456789  \n\täöüß€日本語🎉é́  ▁"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(120)))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, " "), (103, "  x"), (104, "a\x00b"), (105, "<|endoftext|> <s> <unk>"), (106, "word " * 40), (107, "ﬁ"), (None, "The cat sat."), (108, "The cat sat."),
             (108, "The cat sat."), (109, "antidisestablishmentarianism, 'tis we'll\n\n\nx")]
    df = spark.createDataFrame([(d, t, *EXTRA) for d, t in rows], "doc_id long, text string" + CLASH).repartition(3)
    got = sorted(map(tuple, tokenalign.align_tokens(df).collect()), key=str)
    assert got == sorted(brute_align(rows), key=str)
    assert tokenalign.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranks_give_the_ids_of_the_file():
    import public_tokenizers as P
    side = tokenalign.ByteLevel(P.path(tokenalign.A_FILE), P.path(tokenalign.A_RANKS))
    assert side.ranked is not None
    rnd = random.Random(8)
    texts = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, tokenalign.RANKED_BELOW), 32, 10])) for _ in range(rnd.randrange(1, 30))) for _ in range(2000)]
    assert side.encode(texts) == [e.ids for e in side.whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def test_terminals_of_long_chains():
    """Ends that never meet but at the last byte: one group, found by doubling."""
    a, b = np.append(np.arange(2, 2001, 2), 2002), np.append(np.arange(1, 2002, 2), 2002)
    ga, gb = tokenalign.terminals(a, b)
    assert set(ga.tolist()) == set(gb.tolist()) == {len(b) - 1}
