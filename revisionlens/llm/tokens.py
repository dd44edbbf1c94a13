"""Token ids of whole documents in ORC files.

Texts are range-partitioned by ``doc_id`` and sorted, so the files hold ascending
ids and each file's (and stripe's) footer bounds a short range of them.  The ORC
writer stores the ids as an ``array<int>`` column in run-length encoded integer
streams, with a row index every ``ROW_INDEX_STRIDE`` rows and Bloom filters on
``doc_id``: a lookup by id skips files and stripes by their footers, then row groups by index
and filter, and a full read splits at stripes.

A tokenizer whose normaliser and splitter are ``PIECEWISE`` and whose model ends words by
``SUFFIX`` lower-cases a text and cuts it into runs of letters, single digits and runs of signs.
A chunk of texts is cut in numpy by the kinds of its code points, a mark is put after each piece, and all pieces go
to one byte-pair encoder made of the same file's entries, where an ending entry is its bytes and the
mark.  Texts for which that isn't known to be the same (a code point without a kind, such as combining
marks, controls and all above U+FFFF; an added token; a piece of more than ``LONG_PIECE`` letters), and all texts of
other tokenizers, are encoded whole by the tokenizers library.

Nulls and odd input: a null or empty text is only the end id; rows without
``doc_id`` come first; rows of equal ``doc_id`` stand in the order of their texts; other
columns are ignored; an empty table writes an empty folder with the same schema.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from unicodedata import category, is_normalized, ucd_3_2_0

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisionlens.llm.common import frees, prepare, written
from revisionlens.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20
CHUNK_CHARS = 1 << 19        # texts are encoded some at a time
LONG_PIECE = 4096            # the byte-pair encoder is quadratic in a piece
SUFFIX, MARK = "</w>", "\0"
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: What may follow an apostrophe that begins a run of signs, as one piece with it.
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Normaliser and splitter of a tokenizer file that works piece by piece.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
SCHEMA = "doc_id long, n_tokens int, ids array<int>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level splitter's letter of each byte: printable ones stand for themselves, the others count on from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane, for lower-cased text.

    Only code points that are the same in the first Unicode tables and the present ones, and that
    normalisation neither changes nor joins to others, have a kind: marks and Hangul's parts have none.
    """
    of = {"L": LETTER, "N": DIGIT, "P": SIGN, "S": SIGN}
    out = np.full(1 << 16, OTHER, np.uint8)
    for i in [*range(32, 0x1100), *range(0x1200, 0xD800), *range(0xE000, 0xFFFF)]:
        c = chr(i)
        if category(c) == ucd_3_2_0.category(c) and is_normalized("NFC", c):
            out[i] = of.get(category(c)[0], OTHER)
    out[[9, 10, 13, 32]] = SPACE
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker process's encoder: its table serves all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of texts, by pieces where the tokenizer allows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.piecewise = False
        model = parts["model"]
        if all(parts[k] == v for k, v in PIECEWISE.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == SUFFIX:
            self._rank(model["vocab"], [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]])

    def _rank(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        """The byte-pair encoder, if ids rise with the order of the merges: bytes, bytes that end a word, then one entry a merge."""
        import tiktoken
        single = [*BYTE_LETTERS.values()]
        if sorted(vocab[x] for x in single) != [*range(256)] or sorted(vocab[x + SUFFIX] for x in single) != [*range(256, 512)]:
            return
        if [vocab[a + b] for a, b in merges] != [*range(512, len(vocab))]:
            return
        byte_of = {c: b for b, c in BYTE_LETTERS.items()}
        mark = MARK.encode()
        entries = {bytes(byte_of[c] for c in t.removesuffix(SUFFIX)) + (mark if t.endswith(SUFFIX) else b""): i for t, i in vocab.items()}
        if len(entries) != len(vocab):
            return
        self.ends = np.zeros(len(vocab), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(SUFFIX)]] = True
        self.kinds = _kinds()
        self.piecewise = True
        self.ranked = tiktoken.Encoding("pieces", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=entries, special_tokens={})

    def _ends(self, points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where a piece ends."""
        end = (kind != SPACE) & ((kind == DIGIT) | (kind != np.append(kind[1:], SPACE)))
        at = np.flatnonzero(points == ord("'"))
        at = at[(at == 0) | (kind[at - 1] != SIGN)]
        padded = np.append(points, [0, 0])
        for form in SHORT_FORMS:
            here = at[np.all([padded[np.minimum(at + 1 + k, len(points))] == ord(c) for k, c in enumerate(form)], axis=0)]
            end[here] = False
            end[here + len(form)] = True
        return end

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each lower-cased text; None where pieces may not do."""
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        kind = self.kinds[np.minimum(points, 0xFFFF)]
        stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        bad = np.zeros(len(texts), bool)
        bad[np.searchsorted(stop, np.flatnonzero(kind == OTHER), "right")] = True
        end = self._ends(points, kind)
        keep = kind != SPACE
        place = np.cumsum(keep)
        last = np.flatnonzero(end)
        long = np.diff(place[last], prepend=0) > LONG_PIECE
        bad[np.searchsorted(stop, last[long], "right")] = True
        if bad.any():
            left = np.repeat(~bad, np.diff(stop, prepend=0))
            keep &= left
            end &= left
        place = np.cumsum(keep.astype(np.int64) + end)
        marked = np.zeros(int(place[-1]), np.uint32)
        marked[(place - 1 - end)[keep]] = points[keep]
        ids = self.ranked.encode_to_numpy(marked.tobytes().decode("utf-32-le")).astype(np.int32)
        after = np.append(0, np.flatnonzero(self.ends[ids]) + 1)          # ids up to each piece's end
        cut = after[np.append(0, np.cumsum(end)[stop - 1])].tolist()
        return [None if b else ids[x:y] for b, x, y in zip(bad.tolist(), cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        found: list[np.ndarray | None] = [None] * len(texts)
        if self.piecewise:
            own = [i for i, t in enumerate(texts) if not any(a in t for a in self.added)]
            # the tokenizer lower-cases letter by letter: a last sigma is like any other
            for i, ids in zip(own, self._by_pieces([texts[i].replace("\u03a3", "\u03c3").lower() for i in own]) if own else (), strict=True):
                found[i] = ids
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, np.int32)
        return [np.append(ids, np.int32(END_ID)) for ids in found]


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            part: list[str] = []
            lo = size = 0
            for i, text in enumerate(batch.column(1)):
                part.append(text.as_py() or "")
                size += len(part[-1])
                if size >= CHUNK_CHARS or i == batch.num_rows - 1:
                    found = encoder.encode(part)
                    n = np.array([len(x) for x in found], np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(found)))
                    yield pa.record_batch([batch.column(0).slice(lo, len(part)), pa.array(n), ids], names=["doc_id", "n_tokens", "ids"])
                    part, lo, size = [], i + 1, 0
    return encoded


def write_tokens(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode all texts and write them to ``folder`` as ORC in ascending ``doc_id`` order."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.mapInArrow(frees(_encoding(path or tokenizer_path())), SCHEMA)
    (rows.write.mode("overwrite").option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.create.index", "true")
     .option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(folder))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of a folder; a filter on ``doc_id`` prunes files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(folder)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)],
                              names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids before it in two steps: inside each block of files'
    rows, and over the blocks' totals, so that no task sorts all documents.
    """
    prepare(spark)
    d = read_tokens(spark, folder).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"),
                                         F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("row"))
    d = d.mapInArrow(frees(_crc), "doc_id long, n_tokens long, ids_crc32 long, file string, row struct<block: long, row: long>")
    d = written(d, "token-index")
    total = d.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # files hold ranges of ids in the order of their names' part numbers
    before = W.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return d.join(total, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents' ids to a folder of the shared checkpoint folder and return their :func:`token_index`."""
    import uuid
    spark = documents.sparkSession
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(documents, folder, path)
    return token_index(spark, folder)
