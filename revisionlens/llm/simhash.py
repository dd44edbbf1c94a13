"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint: its text with A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``, every three-word shingle with repeats (fewer words: the
whole sequence), the XXH64 (UTF-8, seed 42) of each, and a bit for every
position that is set in more than half of the hashes.  Fingerprints link at
``RADIUS`` or fewer differing bits.

The comparison is exact and never meets all pairs:

* Equal fingerprints are one node, pre-aggregated; its smallest ``doc_id``
  stands for it.
* A fingerprint's cell is the set bits of each of its ``PARTS`` equal parts.
  Two fingerprints differ in at least as many bits as their parts' counts differ
  in sum, so cells whose counts differ by more than the radius can't hold a
  link: those tile pairs are skipped (1.4 % of the pairs are left at sf0.1).
* A cell's fingerprints are packed into tiles of about ``TILE``, by hash, so a hot
  cell is many tiles.  Tile pairs are an equi-join of tiles with the cells
  within reach; each is one block of exclusive-or and bit counts in numpy, at
  most ``BLOCK`` rows at a time.
* A tile pair returns its links as stars (every fingerprint with the smallest one
  linked to it inside the tile pair): no link is lost for the components, and a
  task returns at most two rows a fingerprint however many links there are.

Nulls and odd input: null, empty and wordless texts have fingerprint zero and
are linked like any other; a row without ``doc_id`` has a fingerprint but no
component (null); rows of one ``doc_id`` with other texts are one node, so the
component holds what any of them is linked to; repeated rows give repeated result
rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare, written
from revisionlens.llm.components import components

SEED, WIDTH, RADIUS = 42, 3, 2
PARTS = 4              # parts of 64 / PARTS bits whose set bits are counted
TILE = 2048            # fingerprints in a tile
BLOCK = 256            # rows of a tile compared at once
SPAN = 1 << 15         # shingles hashed at once


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text; shingles are hashed ``SPAN`` at a time, so a long text takes no more memory than its words."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()       # bytes: only A-Z change, only [\x20\x09-\x0D] split
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, last = end - size, end[min(WIDTH, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(last), SPAN):
        spans = zip(start[lo:lo + SPAN].tolist(), last[lo:lo + SPAN].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _reach(parts: int, radius: int) -> list[tuple[int, ...]]:
    """The differences of two cells' counts that add up to the radius or less; of each pair of directions only one."""
    every = (d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius)
    return [d for d in every if d >= (0,) * parts]


def _linked(radius: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (own tile, other tile, same): stars of the links between two tiles or inside one."""
        near, at_a, at_b = np.uint8(radius), [], []
        for batch in batches:
            for x, y, same in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                found = []
                for lo in range(0, len(a), BLOCK):
                    hit = np.bitwise_count(a[lo:lo + BLOCK, None] ^ b[None, :]) <= near
                    i, j = np.nonzero(hit)
                    found.append((i + lo, j))
                i, j = (np.concatenate(z) for z in zip(*found, strict=True))
                if same.as_py():
                    nodes, up = a, i < j
                    i, j = i[up], j[up]
                else:
                    nodes, j = np.concatenate([a, b]), j + len(a)
                if len(i):
                    low, high = _stars(nodes, i, j)
                    at_a.append(high)
                    at_b.append(low)
            if at_a:
                yield pa.record_batch([pa.array(np.concatenate(z).view(np.int64)) for z in (at_a, at_b)], names=["a", "b"])
                at_a, at_b = [], []
    return linked


def _stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between positions i and j: (the least node of its component, node) of every linked node but the least."""
    lab = nodes.copy()
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        if (new == lab).all():
            break
        lab = new
    moved = lab != nodes
    return lab[moved], nodes[moved]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cell, chunk, fp) to one row a tile; only a tile's rows are held."""
    key, held = None, []

    def tile() -> pa.RecordBatch:
        fps = np.concatenate(held)
        return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([fps.tobytes()], pa.binary())],
                               names=["cell", "chunk", "fps"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, chunk, fp = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
            now = int(cell[lo]), int(chunk[lo])
            if now != key and held:
                yield tile()
                held = []
            key = now
            held.append(fp[lo:hi])
    if held:
        yield tile()


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct 64-bit values of column ``fp`` that differ in at most ``radius`` bits.

    The links of a tile pair come as stars: their components are those of all links.
    """
    bits, base = 64 // parts, 64 // parts + 1 + 2 * radius            # counts are shifted by the radius: neighbours never wrap
    mask = F.lit((1 << bits) - 1).cast("long")
    cell = F.lit(0).cast("long")
    for p in range(parts):
        cell = cell * base + F.bit_count(F.shiftrightunsigned("fp", p * bits).bitwiseAND(mask)) + radius
    cells = written(fps.select("fp", cell.alias("cell")), "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("long").alias("chunks"))
    rows = cells.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), "fp")
    tiles = rows.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk").mapInArrow(_packed, "cell long, chunk long, fps binary")
    tiles = written(tiles, "tiles")

    step = [sum(x * base ** (parts - 1 - p) for p, x in enumerate(d)) for d in _reach(parts, radius)]
    sent = tiles.select(F.explode(F.array(*[F.col("cell") + F.lit(s).cast("long") for s in step])).alias("cell"), F.col("cell").alias("from"),
                        F.col("chunk").alias("part"), F.col("fps").alias("sent"))
    pairs = sent.join(tiles, "cell").filter("from != cell or part <= chunk")
    pairs = pairs.select("sent", "fps", ((F.col("from") == F.col("cell")) & (F.col("part") == F.col("chunk"))).alias("same"))
    return pairs.mapInArrow(_linked(radius), "a long, b long").distinct()


def simhash_groups(documents: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id`` (see the module's text)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = written(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = written(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    near = written(links(nodes.select("fp"), radius), "near")
    a, b = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    edges = near.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # a doc_id with several fingerprints joins their nodes
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high").select("doc_id")
    own = fps.join(several, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(own))
    of = nodes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(of, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
