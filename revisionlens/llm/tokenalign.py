"""Alignment of two tokenizers' tokens by pointer jumping.

Each text is encoded by A (byte-level BPE, on a space and the text) and by B
(a piece model that adds the space itself).  Both sides' tokens cut the same bytes,
so a token is a byte range.  Steps inside an Arrow batch, a few hundred
kilobytes of text at a time:

* Every token points to the farthest-right token of the other side that it
  overlaps; tokens that end together point to the B token there, which points to
  itself.  Successors are doubled (``s = s[s]``) until nothing changes: each token
  then holds the terminal token of its component, which labels its group.
* Links are the token pairs whose ranges overlap: one for every stretch between
  neighbouring ends of either side.

Corpus-wide, a pair of ids (a, b) counts the documents that hold it linked:
each document sends its distinct pairs once, they are counted with partial
aggregation, the counts meet the documents' pairs again in an equi-join by
pair, and sums go back to the document's row.  A frequent pair has at most one
row a document in these joins, and adaptive execution splits it.

A's file is read by the tokenizers library.  If a file with the same vocabulary as ranks is
given and holds the very same entries, texts of code points below ``RANKED_BELOW`` are
encoded from it: the ids are equal and it is several times as fast.

Nulls and odd input: a null or empty text, and a text whose tokens' bytes aren't
the space and the text (some normalising model), has no tokens: zeros and an empty
``groups_sha256``.  Each row is a document: repeated rows count twice, rows without
``doc_id`` are kept and counted.  Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare, written

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
RANKED_BELOW = 0x3000
CHUNK_CHARS = 1 << 18
#: Ids of B are below this: a pair of ids is one long.
B_SPAN = 1 << 24
DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, times: int>>"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others counted on from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: the bytes of each id and their number."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        digits = [str(i).encode() for i in range(len(entries))]
        wide = len(digits[-1]) + 1 if digits else 1
        self.text = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), np.uint8).reshape(-1, wide)      # decimal ids and room for a sign
        self.digits = np.fromiter(map(len, digits), np.int64, len(digits))

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class ByteLevel(Side):
    """A: a byte-level BPE file, and the same vocabulary as ranks if it is the same."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        of = _byte_of_letter()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        added = {a["id"] for a in json.loads(self.whole.to_str())["added_tokens"]}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = token.encode() if i in added else bytes(of[c] for c in token)
        super().__init__(entries)
        self.ranked = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            if table == {e: i for i, e in enumerate(entries) if i not in added}:
                self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.ranked is not None and (t.isascii() or np.frombuffer(t.encode("utf-32-le"), np.uint32).max() < RANKED_BELOW) for t in texts]
        rest = iter(self.whole.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.ranked.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]


class Pieces(Side):
    """B: a piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        super().__init__([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in zip(every, map(self.model.id_to_piece, every), strict=True)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_SIDES: dict[tuple, tuple[ByteLevel, Pieces]] = {}


def sides(a: str, ranks: str | None, b: str) -> tuple[ByteLevel, Pieces]:
    """The worker process's tokenizers."""
    if (a, ranks, b) not in _SIDES:
        _SIDES[a, ranks, b] = ByteLevel(a, ranks), Pieces(b)
    return _SIDES[a, ranks, b]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two increasing lists of ends with the same last one, the terminal B token of each A and each B token.

    Pointer jumping: token to farthest-right overlapping token of the other side, doubled until stable.
    """
    n = len(end_a)
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)      # the token that covers the last byte
    stops = end_a[to_a] == end_b if n else np.zeros(0, bool)
    s = np.concatenate([to_b + n, np.where(stops, np.arange(len(end_b)) + n, to_a)])
    while True:
        further = s[s]
        if (further == s).all():
            return s[:n] - n, s[n:] - n
        s = further


def aligned(a: Side, b: Side, ids_a: list[list[int]], ids_b: list[list[int]]) -> dict[str, object]:
    """Groups and links of some documents whose two token lists cover the same bytes (an empty list is no tokens)."""
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    docs = len(na)
    ia, ib = (np.fromiter((i for x in z for i in x), np.int64, int(n.sum())) for z, n in ((ids_a, na), (ids_b, nb)))
    end_a, end_b = np.cumsum(a.size[ia]), np.cumsum(b.size[ib])
    doc_a, doc_b = np.repeat(np.arange(docs), na), np.repeat(np.arange(docs), nb)
    group_a, group_b = terminals(end_a, end_b)
    is_end = group_b == np.arange(len(ib))
    n_groups = np.bincount(doc_b[is_end], minlength=docs)

    # the groups' text: A ids, "|", B ids, ";" of each group in turn, by each token's place among all
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
    at_a = np.arange(len(ia)) + np.searchsorted(group_b, group_a)                  # after all B tokens of the groups before
    at_b = np.arange(len(ib)) + np.searchsorted(group_a, group_b, "right")         # after all A tokens up to its group
    wide = max(a.text.shape[1], b.text.shape[1])
    letters = np.zeros((len(ia) + len(ib), wide), np.uint8)
    size = np.zeros(len(ia) + len(ib), np.int64)
    for side, ids, at, last, sign in ((a, ia, at_a, last_a, b"|"), (b, ib, at_b, last_b, b";")):
        letters[at, :side.text.shape[1]] = side.text[ids]
        letters[at, side.digits[ids]] = np.where(last, sign[0], ord(","))
        size[at] = side.digits[ids] + 1
    letters = letters[letters != 0]
    stop = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(na + nb)])]
    sha = [hashlib.sha256(letters[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    # links: the stretches between neighbouring ends; the distinct pairs of each document
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    la, lb = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    doc = doc_a[la]
    order = np.lexsort((ib[lb], ia[la], doc))
    doc, x, y = doc[order], ia[la][order], ib[lb][order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return {"n_a": na, "n_b": nb, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=docs), "sha": sha,
            "pair": (x * B_SPAN + y)[first], "times": np.diff(np.append(first, len(doc))).astype(np.int32),
            "pairs": np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=docs))]).astype(np.int32)}


def _aligning(a: str, ranks: str | None, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, ranks, b)

        def found(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            tokens = []
            some = [t for t in texts if t]
            for t, x, y in zip(some, left.encode(some), right.encode(some), strict=True):
                whole = b" " + t.encode()
                tokens.append((x, y) if left.joined(x) == whole and right.joined(y) == whole else ([], []))
            got = iter(tokens)
            pairs = [next(got) if t else ([], []) for t in texts]
            r = aligned(left, right, [x for x, _ in pairs], [y for _, y in pairs])
            listed = pa.StructArray.from_arrays([pa.array(r["pair"], pa.int64()), pa.array(r["times"], pa.int32())], names=["pair", "times"])
            return pa.record_batch([ids, *(pa.array(r[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(r["sha"], pa.string()),
                                    pa.ListArray.from_arrays(pa.array(r["pairs"]), listed)],
                                   names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

        for batch in batches:
            part: list[str] = []
            lo = size = 0
            for i, text in enumerate(batch.column(1)):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size >= CHUNK_CHARS or i == batch.num_rows - 1:
                    yield found(batch.column(0).slice(lo, len(part)), part)
                    part, lo, size = [], i + 1, 0
    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, n, best``: how many rows of ``pairs`` hold each pair, and 1 where that is the most of its A id (ties included)."""
    n = written(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / B_SPAN).cast("long").alias("a")
    most = n.groupBy(a).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def align_tokens(documents: DataFrame, a: str | None = None, b: str | None = None, ranks: str | None = None,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a``, ``b`` and ``ranks`` are paths of tokenizer files; the default is the public ones.
    """
    spark = documents.sparkSession
    prepare(spark)
    if a is None:
        import public_tokenizers
        a, ranks = public_tokenizers.path(A_FILE), ranks or public_tokenizers.path(A_RANKS)
    if b is None:
        import public_tokenizers
        b = public_tokenizers.path(B_FILE)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_aligning(a, ranks, b), DOCS)
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "aligned")
    linked = docs.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.times")
    counts = written(pair_counts(linked), "scored-pairs")
    scores = (linked.join(counts.hint("shuffle_hash"), "pair").groupBy("row")
              .agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    out = docs.drop("pairs").join(scores, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
