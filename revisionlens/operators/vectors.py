"""Word vectors and the word-pair similarity join (V1-V5).

Distances are Euclidean distances between L2-normalised vectors, as produced by
a normalise + random-projection LSH pipeline.

``near_token_pairs`` is the exact join used by the matcher.  Its unit of work
is a block = one article and two consecutive versions.  Within a block only
*distinct* tokens are compared (a word that occurs 50 times is compared once),
and a block is cut into tiles of at most ``tile`` distinct tokens per side,
so a hot article is spread over many tasks and no task holds more than
``tile x tile`` distances.  Tiles of all sizes go the same way: their rows are
dealt and sorted by tile and stream through ``mapInArrow``, which holds one tile at
a time and does one matrix product for it (only pairs under the cutoff leave).

With a lexicon (one vector a word) vectors don't travel with the words of each version:
articles are dealt to tasks and each task gets the vector of each of its distinct
words once (``with_word_vectors``); only blocks of very many words are cut into tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisionlens.functions import constants as K
from revisionlens.operators.matching import _ARTICLE, group_starts, version_chunk, whole_articles
from revisionlens.session import materialize

VEC = T.ArrayType(T.DoubleType())


def attach_vectors(tokens: DataFrame, lexicon: DataFrame, vector_col: str = "vector",
                   out: str = "word_embedding") -> DataFrame:
    """V1: join each token to its vector in a ``(token, vector)`` lexicon.

    Inner join on the token; the planner (with AQE) picks broadcast only when
    the measured lexicon size is under the broadcast threshold, else a shuffle.
    """
    lex = lexicon.select("token", F.col(vector_col).cast(VEC).alias(out))
    return tokens.join(lex, "token", "inner")


def l2_normalize(df: DataFrame, col: str = "word_embedding", out: str = "norm_word_embedding") -> DataFrame:
    """V2: p=2 normalisation of an array column (zero vectors stay zero)."""
    norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn(out, F.when(norm > 0, F.transform(F.col(col), lambda x: x / norm))
                         .otherwise(F.col(col).cast(VEC)))


def projections(dim: int, num_tables: int, seed: int = 42) -> list[list[float]]:
    """One unit vector a hash table, its parts by rule from the md5 of ``seed:table:part`` (so SQL can state them)."""
    out = []
    for t in range(num_tables):
        v = [int(md5(f"{seed}:{t}:{d}".encode()).hexdigest()[:8], 16) / 2 ** 32 - 0.5 for d in range(dim)]
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v])
    return out


def lsh_hash(df: DataFrame, col: str = "norm_word_embedding", bucket_length: float = 3.0, num_tables: int = 3, seed: int = 42, dim: int = 64,
             out: str = "hashes") -> DataFrame:
    """V3: random-projection hashes ``floor(projection / bucket_length)``, one a table, as an array.

    With unit vectors and bucket length 3 every projection falls in [-1, 1], so
    each table has at most 2 buckets; ``word_pairs_lsh`` takes a width that fits its cutoff.
    """
    dot = lambda p: F.aggregate(F.zip_with(F.col(col), F.array(*map(F.lit, p)), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(out, F.array(*[F.floor(dot(p) / bucket_length).cast("long") for p in projections(dim, num_tables, seed)]))


def word_pairs_lsh(tokens: DataFrame, cutoff: float = K.WORD_DISTANCE_CUTOFF, bucket_length: float | None = None, num_tables: int = 3, seed: int = 42,
                   dim: int = 64, lexicon: DataFrame | None = None) -> DataFrame:
    """V4: approximate word pairs of consecutive versions by random-projection LSH.

    The result is the set a similarity join returns once restricted to one
    article and ``version_y = version_x + 1``: distinct token pairs that share
    a bucket in at least one hash table and lie under the cutoff.  The
    restriction is part of the join key (article, version pair, table,
    bucket), so candidates never leave their article.  Candidates are pairs of
    keys; vectors are joined to them only for the distance.  The bucket width
    is a quarter of the cutoff by default: a pair at the cutoff then differs in a projection
    by half a bucket on average, and wider buckets pair nearly everything.

    With a ``(token, vector)`` lexicon (``tokens`` then needs no vectors) each of its words is hashed
    once, and candidates are met and compared in the task that their article is dealt to.
    """
    keys = ["source", "entry_id", "version"]
    width = cutoff / 4 if bucket_length is None else bucket_length
    if lexicon is not None:
        norm = l2_normalize(lexicon.select("token", F.col("vector").cast(VEC).alias("v")), "v", "norm")
        hashed = lsh_hash(norm, "norm", width, num_tables, seed, dim).select("token", F.concat("norm", F.col("hashes").cast(VEC)).alias("vector"))
        return _lexicon_pairs(tokens, hashed, _bucket_pairs(cutoff, num_tables), 1024)
    vocab = l2_normalize(tokens.select(*keys, "token", "word_embedding").dropDuplicates(keys + ["token"]), "word_embedding", "norm")
    vocab = materialize(vocab.select(*keys, "token", "norm"), "lsh-words")
    h = lsh_hash(vocab, "norm", width, num_tables, seed, dim).select(*keys, "token", F.posexplode("hashes").alias("tbl", "bucket"))
    block = ["source", "entry_id", "version_x"]
    x = h.select("source", "entry_id", F.col("version").alias("version_x"), "tbl", "bucket", F.col("token").alias("token_x"))
    y = h.select("source", "entry_id", (F.col("version") - 1).alias("version_x"), "tbl", "bucket", F.col("token").alias("token_y"))
    cand = x.join(y, [*block, "tbl", "bucket"]).select(*block, "token_x", "token_y").distinct()
    a = vocab.select("source", "entry_id", F.col("version").alias("version_x"), F.col("token").alias("token_x"), F.col("norm").alias("a"))
    b = vocab.select("source", "entry_id", (F.col("version") - 1).alias("version_x"), F.col("token").alias("token_y"), F.col("norm").alias("b"))
    sq = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)
    d = F.when(F.col("token_x") == F.col("token_y"), F.lit(0.0)).otherwise(F.sqrt(sq))
    return (cand.join(a, [*block, "token_x"]).join(b, [*block, "token_y"])
                .select(*block, (F.col("version_x") + 1).alias("version_y"), "token_x", "token_y", d.alias("distance"))
                .filter(F.col("distance") < cutoff))


_PAIR_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("entry_id", T.LongType()),
    T.StructField("version_x", T.IntegerType()),
    T.StructField("version_y", T.IntegerType()),
    T.StructField("token_x", T.StringType()),
    T.StructField("token_y", T.StringType()),
    T.StructField("distance", T.DoubleType()),
])


_TILE = ["source", "entry_id", "version_x", "chunk_x", "chunk_y"]


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def unit_distances(x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Distances of unit rows; equal words are at distance 0 exactly."""
    d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))
    d[equal] = 0.0
    return d


def _near_pairs(cutoff: float):
    """V5's pairs of a block: all under the cutoff."""
    def found(x, y, equal):
        d = unit_distances(unit_rows(x), unit_rows(y), equal)
        i, j = np.nonzero(d < cutoff)
        return i, j, d[i, j]
    return found


def _bucket_pairs(cutoff: float, num_tables: int):
    """V4's pairs of a block: those under the cutoff that share a bucket (the last ``num_tables`` columns are hashes)."""
    def found(x, y, equal):
        (x, hx), (y, hy) = np.hsplit(x, [-num_tables]), np.hsplit(y, [-num_tables])
        candidate = np.zeros((len(x), len(y)), bool)
        for t in range(num_tables):
            candidate |= hx[:, t, None] == hy[None, :, t]
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0))
        d[equal] = 0.0
        i, j = np.nonzero(candidate & (d < cutoff))
        return i, j, d[i, j]
    return found


def _pair_batch(source, entry_id, version_x, token_x, token_y, distance) -> pa.RecordBatch:
    k = len(distance)
    return pa.record_batch([
        pa.array([source] * k, pa.string()), pa.array(np.full(k, entry_id), pa.int64()), pa.array(np.full(k, version_x), pa.int32()),
        pa.array(np.full(k, version_x + 1), pa.int32()), token_x, token_y, pa.array(distance, pa.float64())], schema=_ARROW_PAIR)


def _tile_distances(pairs: Callable):
    """Rows sorted by (tile, side) -> near token pairs; one tile's rows are held at a time."""
    def matrix(col):
        values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return values.reshape(len(col), -1)

    def block(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        n = int((t.column("side").to_numpy() == 0).sum())
        if n in (0, t.num_rows):
            return None
        vec = matrix(t.column("vec").chunk(0))
        token = np.asarray(t.column("token").to_pylist(), dtype=object)
        i, j, d = pairs(vec[:n], vec[n:], token[:n, None] == token[None, n:])
        one = lambda c: t.column(c)[0].as_py()
        return _pair_batch(one("source"), one("entry_id"), one("version_x"), pa.array(token[i].tolist(), pa.string()), pa.array(token[j + n].tolist(), pa.string()), d)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            changed = np.zeros(t.num_rows - 1, bool)
            for c in _TILE:
                v = np.asarray(t.column(c).to_pylist(), dtype=object) if c == "source" else t.column(c).to_numpy()
                changed |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist()]
            for lo, hi in zip(edges[:-1], edges[1:]):
                found = block(t.slice(lo, hi - lo))
                if found is not None:
                    yield found
            held = t.slice(edges[-1])
        if held is not None and held.num_rows:
            found = block(held)
            if found is not None:
                yield found
    return run


def _arrow_schema():
    return pa.schema([("source", pa.string()), ("entry_id", pa.int64()), ("version_x", pa.int32()),
                      ("version_y", pa.int32()), ("token_x", pa.string()), ("token_y", pa.string()),
                      ("distance", pa.float64())])


_ARROW_PAIR = _arrow_schema()


def near_token_pairs(tokens: DataFrame, cutoff: float = K.WORD_DISTANCE_CUTOFF, tile: int = 1024,
                     vector_col: str = "word_embedding", lexicon: DataFrame | None = None) -> DataFrame:
    """V5 (exact, token level): distinct token pairs of consecutive versions of
    one article whose vector distance is below ``cutoff``.

    With a ``(token, vector)`` lexicon ``tokens`` needs no vectors; else each word of a version has its own.

    Output: ``source, entry_id, version_x, version_y, token_x, token_y, distance``.
    """
    if lexicon is not None:
        return _lexicon_pairs(tokens, lexicon, _near_pairs(cutoff), tile)
    return _tile_pairs(tokens.select("source", "entry_id", "version", "token", F.col(vector_col).alias("vec")), _near_pairs(cutoff), tile)


def _tile_pairs(words: DataFrame, pairs: Callable, tile: int) -> DataFrame:
    """Pairs of words that carry their vectors, each block cut into tiles of at most about ``tile`` words a side."""
    keys = ["source", "entry_id", "version"]
    vocab = words.dropDuplicates(keys + ["token"])
    sizes = vocab.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("token"), F.col("k_mine")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k_other") - 1))
    own = vocab.join(sizes.withColumnRenamed("k", "k_mine"), keys)
    side = lambda shift, chunks, n: own.join(sizes.select(*keys[:2], (F.col("version") + shift).alias("version"), F.col("k").alias("k_other")), keys).select(
        "source", "entry_id", F.col("version").alias("version_x"), *chunks, F.lit(n).alias("side"), "token", "vec")
    x = side(-1, (mine.alias("chunk_x"), other.alias("chunk_y")), 0)
    y = side(1, (other.alias("chunk_x"), mine.alias("chunk_y")), 1).withColumn("version_x", F.col("version_x") - 1)
    rows = x.unionByName(y).repartition(*_TILE).sortWithinPartitions(*_TILE, "side")
    return rows.mapInArrow(_tile_distances(pairs), schema=_PAIR_SCHEMA)


def with_word_vectors(rows: DataFrame, lexicon: DataFrame, order: list[str], run: Callable, schema) -> DataFrame:
    """V1 by task: rows with an article (``source, entry_id, chunk``) and ``words`` are dealt by article, as many parts as the
    session shuffles to, and each part gets the vector of each of its distinct words once.

    ``run(tokens, vectors, batches)`` gets a part's words, their vectors as a matrix and the part's
    rows, sorted by article and ``order``, as batches.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*_ARTICLE), F.lit(parts)).cast("int"))
    words = rows.repartitionById(parts, "part").select("part", F.explode("words").alias("token")).distinct()
    vectors = attach_vectors(words, lexicon, out="vec").withColumn("kind", F.lit(0))
    dealt = rows.withColumn("kind", F.lit(1)).unionByName(vectors, allowMissingColumns=True).repartitionById(parts, "part")

    def split(batches):
        tokens, vectors, rest = [], [], iter(batches)
        for b in rest:
            k = int(np.searchsorted(b.column("kind").to_numpy(), 1))
            if k:
                tokens.append(b.column("token").slice(0, k))
                vectors.append(b.column("vec").slice(0, k).flatten().to_numpy(zero_copy_only=False))
            if k < b.num_rows:
                if tokens:
                    known = pa.concat_arrays(tokens)
                    tokens.clear()
                    matrix = np.concatenate(vectors).reshape(len(known), -1)
                    vectors.clear()
                    yield from run(known, matrix, chain([b.slice(k)], rest))
                return

    return dealt.sortWithinPartitions("kind", *_ARTICLE, *order).mapInArrow(split, schema)


#: Blocks of more distances than this are cut into tiles.
LARGE_BLOCK = 1 << 22


def _lexicon_pairs(tokens: DataFrame, lexicon: DataFrame, pairs: Callable, tile: int) -> DataFrame:
    """The pairs of the words of consecutive versions, with one vector a word of the lexicon."""
    keys, large_block = ["source", "entry_id", "version"], LARGE_BLOCK
    words = (tokens.filter("source is not null and entry_id is not null and version is not null")
                   .groupBy(*keys).agg(F.collect_set("token").alias("words")))
    words = materialize(words, "version-words")

    def blocks(known, matrix, batches):
        for t in whole_articles(batches):
            version = t.column("version").to_numpy()
            starts = np.isin(np.arange(t.num_rows), group_starts(t, _ARTICLE))
            lists = t.column("words").combine_chunks()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            out, k = [], 0
            for r in np.flatnonzero(~starts[1:] & (version[1:] == version[:-1] + 1) & (np.diff(at)[1:] * np.diff(at)[:-1] <= large_block)):
                x, y = (ids[at[v]:at[v + 1]] for v in (r, r + 1))
                x, y = x[x >= 0], y[y >= 0]
                if not (len(x) and len(y)):
                    continue
                i, j, d = pairs(matrix[x], matrix[y], x[:, None] == y[None, :])
                out.append((np.full(len(d), r), x[i], y[j], d))
                k += len(d)
                if k >= 1 << 18:
                    yield batch(t, known, out)
                    out, k = [], 0
            if k:
                yield batch(t, known, out)

    def batch(t, known, out):
        row, x, y, d = map(np.concatenate, zip(*out, strict=True))
        row = pa.array(row)
        version = t.column("version").to_numpy()[row]
        flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return pa.record_batch([flat(t.column("source").take(row)), flat(t.column("entry_id").take(row)), pa.array(version, pa.int32()), pa.array(version + 1, pa.int32()),
                                known.take(pa.array(x)), known.take(pa.array(y)), pa.array(d, pa.float64())], schema=_ARROW_PAIR)

    chunks = F.explode(F.array_distinct(F.array(version_chunk(F.col("version")), version_chunk(F.col("version") - 1))))
    near = with_word_vectors(words.select("source", "entry_id", chunks.alias("chunk"), "version", "words"), lexicon, ["version"], blocks, _PAIR_SCHEMA)

    sizes = words.select(*keys[:2], F.col("version").alias("version_x"), F.size("words").cast("long").alias("k"))
    after = sizes.select(*keys[:2], (F.col("version_x") - 1).alias("version_x"), F.col("k").alias("k_y"))
    large = materialize(sizes.join(after, [*keys[:2], "version_x"]).filter(F.col("k") * F.col("k_y") > large_block).select(*keys[:2], "version_x"), "large-blocks")
    if not large.head(1):
        return near
    versions = large.select(*keys[:2], F.explode(F.array("version_x", F.col("version_x") + 1)).alias("version")).distinct()
    theirs = words.join(versions, keys, "left_semi").select(*keys, F.explode("words").alias("token"))
    tiles = _tile_pairs(attach_vectors(theirs, lexicon, out="vec"), pairs, tile)
    return near.unionByName(tiles.join(large, [*keys[:2], "version_x"], "left_semi").select(near.columns))


def word_pairs_exact(tokens: DataFrame, near: DataFrame | None = None, cutoff: float = K.WORD_DISTANCE_CUTOFF,
                     tile: int = 1024) -> DataFrame:
    """V5 (exact, position level): the word-pair stream a similarity join emits:
    one row per (word of version x, word of version y) under the cutoff, with
    sentence indices, word indices and per-side sentence lengths.

    ``tokens`` has ``word_idx`` (``explode_tokens``) and, unless ``near`` is
    given, a ``word_embedding`` column.  The distance test runs on distinct
    tokens (``near_token_pairs``); positions are attached by equi-joins.
    """
    if near is None:
        near = near_token_pairs(tokens, cutoff, tile)
    base = ["source", "entry_id"]
    tx = tokens.select(*base, F.col("version").alias("version_x"), F.col("token").alias("token_x"),
                       F.col("sent_idx").alias("sent_idx_x"), F.col("word_idx").alias("word_idx_x"),
                       F.col("num_words").alias("num_words_x"))
    ty = tokens.select(*base, F.col("version").alias("version_y"), F.col("token").alias("token_y"),
                       F.col("sent_idx").alias("sent_idx_y"), F.col("word_idx").alias("word_idx_y"),
                       F.col("num_words").alias("num_words_y"))
    return (near.join(tx, base + ["version_x", "token_x"])
                .join(ty, base + ["version_y", "token_y"])
                .select(*base, "version_x", "version_y", "sent_idx_x", "sent_idx_y",
                        "word_idx_x", "word_idx_y", "num_words_x", "num_words_y", "token_x", "token_y",
                        "distance"))
