"""MinHash near-duplicates with HyperMinHash registers.

A document's set is its distinct five-word shingles.  One pass hashes each
shingle once: the top bits choose one of 256 registers and the register keeps
the smallest rest of the hash as its count of leading zeros and ten mantissa
bits (two bytes).  Empty registers borrow from a full one in an order fixed by
the register's number, so small sets band like large ones.

* Documents with equal sets are one class; the smallest ``doc_id`` stands for it.
* 48 bands of five registers each: two sets of similarity 0.75 miss every band
  with a probability of (1 - 0.75**5)**48 = 2e-6.
* Links are looked for in three turns.  First each document against the smallest
  id that it shares a bucket with (one pair a document).  Then each member of a
  band's bucket against the bucket's smallest id, if they are still in different
  components.  Then, only in buckets whose members still are, the pairs across
  components (of small sets an upper bound of the intersection decides, from 16
  bits of each shingle; of others the registers' low bytes): large buckets are cut into tiles, and a pair leaves its task
  only if it passes.
* Every pair passes the collision-corrected Jaccard estimate of the full
  registers (with a margin of 4.5 standard deviations) and is then confirmed on
  the full sets: ``100 * |A and B| >= 75 * |A or B|``.

Hot groups: the classes, the buckets' minima and the stars of the component
search are pre-aggregated; joins are plain equi-joins that adaptive execution
can split; tiles bound what one group brings to a task.

Nulls and odd input: a null or empty text has an empty set and is linked with
nothing; a row without ``doc_id`` has no component (``component_id`` null) and is
kept; repeated rows give repeated result rows; rows that repeat a ``doc_id`` with
other texts are one document, linked with all that any of them is linked with (each
keeps its own ``n_shingles``); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import checked_broadcast, frees, prepare, written
from revisionlens.llm.components import components
from revisionlens.llm.textbatch import chunks, mix, shingle_sets

BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
BANDS, ROWS = 48, 5
CODED, NO_CODE = 512, 1 << 16      # sets of up to so many shingles also travel as 16-bit codes
TILE = 256           # members of a bucket that are compared in one block
SIMILARITY = (75, 100)

_ORDER: np.ndarray | None = None


def _borrow_order() -> np.ndarray:
    """Row j: all registers in the order in which register j looks for a full one."""
    global _ORDER
    if _ORDER is None:
        j = np.arange(REGISTERS, dtype=np.uint64)
        _ORDER = np.argsort(mix(j[:, None] * np.uint64(REGISTERS) + j[None, :] + np.uint64(7)), axis=1)
    return _ORDER


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 256 two-byte registers of a non-empty sorted set of 64-bit hashes."""
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = shingles[first] << np.uint64(BUCKET_BITS)
    zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11
    zeros = np.where(rest == 0, 64 - BUCKET_BITS, zeros)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    if len(first) < REGISTERS:
        full = np.zeros(REGISTERS, bool)
        full[bucket[first]] = True
        empty = np.flatnonzero(~full)
        order = _borrow_order()[empty]
        out[empty] = out[order[np.arange(len(empty)), np.argmax(full[order], axis=1)]]
    return out


_BAND_MUL = mix(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_ADD = mix(np.arange(900, 900 + BANDS, dtype=np.uint64))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band of five registers."""
    part = regs[:BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    x = _BAND_ADD.copy()
    for i in range(ROWS):
        x = mix(x + (part[:, i] + np.uint64(1)) * _BAND_MUL[i])
    return x


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets of n and m elements agree.

    Per register about n/256 and m/256 elements compete; the chance is the sum
    over all register values of the product of both probabilities, taken on a
    grid of sizes (powers of two) from 1 to 2**24.
    """
    grid = _collision_grid()
    at = lambda x: np.clip(np.rint(np.log2(np.maximum(x, 1))), 0, len(grid) - 1).astype(int)
    return grid[at(n), at(m)]


_GRID: np.ndarray | None = None


def _collision_grid() -> np.ndarray:
    global _GRID
    if _GRID is None:
        zeros = np.arange(24)[:, None]
        low = (2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA_BITS)[None, :] / (1 << MANTISSA_BITS))).ravel()
        wide = np.repeat(2.0 ** -(zeros + 1) / (1 << MANTISSA_BITS), 1 << MANTISSA_BITS)
        p = []
        for size in 2.0 ** np.arange(25):
            each = max(1.0, size / REGISTERS)
            p.append(np.exp(each * np.log1p(-low)) - np.exp(each * np.log1p(-np.minimum(low + wide, 1 - 1e-15))))
        p = np.array(p)
        _GRID = p @ p.T
    return _GRID


def estimated(agree: np.ndarray, n: np.ndarray, m: np.ndarray, width: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity from agreeing registers, corrected for chance collisions."""
    c = collision_rate(n, m)
    return (agree / width - c) / (1 - c)


def margin(n: np.ndarray, m: np.ndarray, width: int = REGISTERS) -> np.ndarray:
    """4.5 standard deviations of the estimate at 0.75, given the registers that are really full."""
    full = width * -np.expm1(-np.minimum(n, m) / REGISTERS)
    return 4.5 * np.sqrt(0.1875 / np.maximum(full, 1)) + 0.01


def _binary(rows: np.ndarray) -> pa.Array:
    """An Arrow binary array of equally long rows of a 2-d array."""
    rows = np.ascontiguousarray(rows)
    wide = rows.shape[1] * rows.itemsize
    at = np.arange(0, (len(rows) + 1) * wide, wide, dtype=np.int32) if wide else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _matrix(a: pa.Array, kind, width: int) -> np.ndarray:
    """The 2-d array back from :func:`_binary`."""
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8)[at[0]:at[-1]]
    return raw.view(kind).reshape(len(a), width)


SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, regs binary, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in chunks(batch.column(1)):
            sets = shingle_sets(texts)
            n = np.array([len(x) for x in sets], np.int64)
            regs = np.zeros((len(sets), REGISTERS), np.uint16)
            keys = np.zeros((len(sets), BANDS), np.uint64)
            fp = np.zeros((2, len(sets)), np.uint64)
            for i, x in enumerate(sets):
                if len(x):
                    regs[i] = registers(x)
                    keys[i] = band_keys(regs[i])
                    fp[:, i] = x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            none = n == 0
            yield pa.record_batch([
                batch.column(0).slice(lo, hi - lo), pa.array(n),
                pa.array(fp[0].view(np.int64), mask=none), pa.array(fp[1].view(np.int64), mask=none), _binary(regs),
                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "fp1", "fp2", "regs", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its full set, as sorted 64-bit hashes."""
    for batch in batches:
        for lo, hi, texts in chunks(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], names=["doc_id", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimated similarity may reach the threshold."""
    for batch in batches:
        if batch.num_rows:
            a, b, na, nb = (batch.column(i) for i in range(4))
            n, m = na.to_numpy().astype(float), nb.to_numpy().astype(float)
            agree = (_matrix(batch.column(4), np.uint16, REGISTERS) == _matrix(batch.column(5), np.uint16, REGISTERS)).sum(axis=1)
            keep = estimated(agree, n, m) >= SIMILARITY[0] / SIMILARITY[1] - margin(n, m)
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            keep.append(both > 0 and SIMILARITY[1] * both >= SIMILARITY[0] * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _once(rows: DataFrame, repeated: bool) -> DataFrame:
    """One of each id's rows.  They are wide, so they are sorted and merged only where ids are ``repeated``."""
    return rows.dropDuplicates(["doc_id"]) if repeated else rows


def links(docs: DataFrame, sketch: DataFrame, pairs: DataFrame, repeated: bool = True) -> DataFrame:
    """Of the candidate ``pairs`` (a, b) those that are links: estimate first, then the full sets.

    ``repeated``: whether ids may repeat in ``docs``.
    """
    a = sketch.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    b = sketch.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    bounded = "100 * least(na, nb) >= 75 * greatest(na, nb)"
    both = pairs.join(a, "a").join(b, "b").filter(bounded).select("a", "b", "na", "nb", "ra", "rb")
    likely = written(both.mapInArrow(frees(_likely), "a long, b long"), "likely")
    ids = written(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = written(docs.join(checked_broadcast(ids, ids.count()), "doc_id", "left_semi").mapInArrow(frees(_sets), "doc_id long, shingles binary"), "sets")
    sets = _once(sets, repeated)
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return written(likely.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(frees(_confirmed), "a long, b long"), "links")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components within a tile that may be links.

    Rows come sorted by (key, i, j); columns key, i, j, side, doc_id, component, n, short, codes.
    """
    left: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]) if left is not None else t
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        k = np.stack([t.column(i).to_numpy() for i in range(3)])
        cut = np.flatnonzero((np.diff(k, axis=1) != 0).any(axis=0)) + 1
        last = int(cut[-1]) if len(cut) else 0
        yield from _compared(t.slice(0, last), cut)
        left = t.slice(last)
    if left is not None and left.num_rows:
        yield from _compared(left, np.zeros(0, int))


def _compared(t: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    t = t.combine_chunks()
    side, doc, comp, n = (t.column(i).to_numpy() for i in range(3, 7))
    short = _matrix(t.column(7).chunk(0), np.uint8, REGISTERS)
    a, b = [], []
    edges = [0, *[int(x) for x in cut if x < t.num_rows], t.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        rows = np.arange(lo, hi)
        both = side[lo] < 0                          # a tile of a chunk with itself
        one = rows[side[lo:hi] <= 0]
        two = one if both else rows[side[lo:hi] != 0]
        if not len(one) or not len(two):
            continue
        codes = [np.frombuffer(x.as_buffer(), np.uint16) for x in t.column(8).slice(lo, hi - lo)]
        wide = np.full((hi - lo, max(map(len, codes))), NO_CODE, np.int32)
        for k, x in enumerate(codes):
            wide[k, :len(x)] = x
        for r in one:
            c = two[two > r] if both else two
            c = c[(comp[c] != comp[r]) & (100 * np.minimum(n[c], n[r]) >= 75 * np.maximum(n[c], n[r]))]
            if not len(c):
                continue
            exact = (n[c] <= CODED) & (n[r] <= CODED)
            agree = (short[c] == short[r]).sum(axis=1)
            est = (agree / REGISTERS - 1 / 256) / (1 - 1 / 256)
            keep = exact | (est >= 0.75 - margin(n[c].astype(float), np.full(len(c), float(n[r]))))
            if exact.any():
                held = np.zeros(NO_CODE + 1, np.int32)
                np.add.at(held, codes[r - lo], 1)
                most = held[wide[c[exact] - lo]].sum(axis=1)          # at least the size of the intersection
                keep[exact] = 100 * most >= 75 * (n[c[exact]] + n[r] - most)
            a.append(np.full(int(keep.sum()), doc[r]))
            b.append(doc[c[keep]])
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the low bytes of its registers and, of a set of up to CODED shingles, 16 bits of each."""
    for batch in batches:
        for lo, hi, texts in chunks(batch.column(1)):
            sets = shingle_sets(texts)
            regs = np.array([registers(x) if len(x) else np.zeros(REGISTERS, np.uint16) for x in sets]).astype(np.uint8)
            codes = [(x & np.uint64(NO_CODE - 1)).astype(np.uint16).tobytes() if len(x) <= CODED else b"" for x in sets]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), _binary(regs), pa.array(codes, pa.binary())],
                                  names=["doc_id", "n", "short", "codes"])


def pairs_across(docs: DataFrame, members: DataFrame, found: DataFrame, repeated: bool = True) -> DataFrame:
    """Candidate pairs between different components of ``found`` that share a bucket of ``members`` (key, doc_id).

    A bucket of up to ``TILE`` members is one tile.  A larger one is cut into
    chunks: one component with more than ``TILE`` members has chunks of its own
    (never paired with each other), all others share hashed chunks; every pair of
    chunks is a tile.  ``repeated``: whether ids may repeat in ``docs``.
    """
    m = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    own = m.groupBy("key", "component").agg(F.count("*").alias("own"))
    sizes = own.groupBy("key").agg(F.sum("own").alias("all"), F.count("*").alias("parts"), F.sum(F.when(F.col("own") <= TILE, F.col("own")).otherwise(0)).alias("rest")).filter("parts > 1")
    m = m.join(sizes, "key")
    large = own.filter(F.col("own") > TILE)
    m = m.join(large, ["key", "component"], "left")
    spread = F.xxhash64("doc_id")
    part = (F.when(F.col("all") <= TILE, F.struct(F.lit(None).cast("long").alias("of"), F.lit(0).cast("long").alias("no")))
            .when(F.col("own").isNotNull(), F.struct(F.col("component").alias("of"), F.pmod(spread, F.ceil(F.col("own") / TILE)).alias("no")))
            .otherwise(F.struct(F.lit(None).cast("long").alias("of"), F.pmod(spread, F.greatest(F.ceil(F.col("rest") / TILE), F.lit(1))).alias("no"))))
    m = m.select("key", "doc_id", "component", part.alias("part"))
    m = written(m.select("key", "doc_id", "component", F.xxhash64("part.of", "part.no").alias("chunk"), F.col("part.of").alias("of")), "mixed")
    parts = m.select("key", "chunk", "of").distinct()
    other = parts.select("key", F.col("chunk").alias("j"), F.col("of").alias("of_j"))
    tiles = parts.select("key", F.col("chunk").alias("i"), "of").join(other, "key").filter("(i < j or (i = j and of is null)) and not (of <=> of_j and of is not null)").select("key", "i", "j")
    ids = written(m.select("doc_id").distinct(), "mixed-ids")
    short = docs.join(checked_broadcast(ids, ids.count()), "doc_id", "left_semi").mapInArrow(frees(_short), "doc_id long, n long, short binary, codes binary")
    short = _once(written(short, "short"), repeated)
    ends = tiles.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("chunk"), F.lit(-1).cast("long").alias("side"))))
                        .otherwise(F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).cast("long").alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).cast("long").alias("side"))))).alias("x"))
    ends = ends.select("key", "i", "j", F.col("x.chunk").alias("chunk"), F.col("x.side").alias("side"))
    rows = m.join(ends, ["key", "chunk"]).join(short, "doc_id").select("key", "i", "j", "side", "doc_id", "component", "n", "short", "codes")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return rows.mapInArrow(frees(_across), "a long, b long").distinct()


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of ``found``."""
    a, b = found.select(F.col("id").alias("a"), F.col("component").alias("ca")), found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept`` (see the module's text)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = written(docs.mapInArrow(frees(_sketches), SKETCH), "sketch")
    held = [F.coalesce("fp1", F.lit(0)), F.coalesce("fp2", F.lit(0)), F.col("n_shingles")]
    differ = functools.reduce(operator.or_, (F.min(x) != F.max(x) for x in held))
    ids = sketch.filter("doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"), differ.alias("differ"))
    repeated, several = ids.agg(F.max("repeated"), F.max("differ")).first()
    return _of_rows(docs, sketch) if several else _of_ids(docs, sketch, bool(repeated))


def _of_rows(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Where ids repeat with other texts: each row is linked by itself, then rows of one id unite their components."""
    rows = written(docs.filter("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    found = _of_ids(texts, written(texts.mapInArrow(frees(_sketches), SKETCH), "row-sketch"), False)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("of"))
    found = written(rows.select("row", "doc_id").join(found, "row"), "row-components")
    linked = found.filter("n_shingles > 0")
    low = linked.groupBy("of").agg(F.min("doc_id").alias("low"))
    united = components(linked.join(low, "of").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    out = found.join(united.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = sketch.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _of_ids(docs: DataFrame, sketch: DataFrame, repeated: bool) -> DataFrame:
    """The result where rows of one id have equal sets; ``repeated``: whether an id has several."""
    # one class for each distinct set
    full = sketch.filter("fp1 is not null and doc_id is not null")
    classes = written(full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    of_reps = full.join(reps, "doc_id", "left_semi")

    # buckets: pre-aggregated minima first, then the members of those with several
    keyed = written(of_reps.select("doc_id", F.explode("bands").alias("key")), "bands")
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high")
    buckets = written(buckets, "buckets")
    members = written(keyed.join(buckets.filter("n > 2").select("key", "low"), "key"), "members")
    stars = buckets.filter("n = 2").select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(
        members.filter("doc_id != low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).distinct()
    stars = written(stars, "stars")
    sketch_of_reps = _once(sketch.filter("fp1 is not null").select("doc_id", "n_shingles", "regs"), repeated)

    # one pair a document first; then what is still in different components
    found = components(links(docs, sketch_of_reps, stars.groupBy("a").agg(F.min("b").alias("b")), repeated))
    for pairs in (lambda: _between(stars, found), lambda: pairs_across(docs, members.select("key", "doc_id"), found, repeated)):
        more = written(pairs(), "pairs")
        if more.head(1):
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links(docs, sketch_of_reps, more, repeated)))

    # every document by its class, every class by its component
    class_of = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    s = sketch.select("doc_id", "n_shingles", "fp1", "fp2")
    out = s.join(class_of, (s.fp1 == class_of.fp1) & (s.fp2 == class_of.fp2) & (s.n_shingles == class_of.n), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
