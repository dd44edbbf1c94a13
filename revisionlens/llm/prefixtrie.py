"""The prefix trie of conversations, from padded turn-id matrices.

Input to the trie: conversations rebuilt with shared openings (:func:`rebuilt`) or
any other ``conv_id, turns`` table.  A turn is known by 128 bits of hashes of role
and text, and by its text's bytes; texts never leave the first step.

1. Conversations are dealt by range of (turn ids, ``conv_id``) into shards of about
   ``SHARD_TURNS`` turns, so members of a node are neighbours, and a node, turn or
   conversation that a third of the rows share is cut over many shards.
2. Inside a shard, numpy: turn ids become ranks in padded matrices (``COLUMNS``
   columns at a time, of the conversations that reach them, so a long conversation
   pads nothing else); ``lexsort`` orders the rows; the column-by-column change
   masks, accumulated by OR, mark where each depth's nodes start; ``reduceat`` and
   prefix sums aggregate members, children, leaves and bytes of every depth.
3. Nodes on the path of a shard's first or last row may go on in the next shard.
   They leave the shard as parts with a key of their prefix (exclusive-or of position-salted
   hashes) and are recombined by key; sums over their subtrees come from the order
   of the paths (a node's subtree is a run of paths), by windows over one row a path.
   All other nodes are final in their shard.
4. Ids of members that end at a node are hashed in the shard; those of recombined
   nodes are sorted by (node, shard) and hashed as a stream, so no task holds them.

A task holds one shard's ids: 20 bytes a turn of about ``SHARD_TURNS`` turns, or of
one longer conversation.

Nulls and odd input: rows without ``conv_id`` are left out; a null turn number comes first;
null role or text is empty; rows of one conversation with equal turn
numbers are ordered by role and text (UTF-8 bytes), equal ones stay both; other columns are ignored; an
empty table has no members and gives an empty result.  Groups of five ids are
counted from zero downwards too: -1 belongs to -5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisionlens.llm.common import checked_broadcast, prepare, written

GROUP, OPENINGS = 5, 9          # fixed values of the rebuilding rule
SHARD_TURNS = 400_000
COLUMNS = 64
ID_BYTES = 1 << 16              # of the ids of a recombined node in one row
TURN = "struct<a: long, b: long, bytes: int>"


# ------------------------------------------------------------------ rebuilding
def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as two hashes and the text's bytes."""
    c = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = c.select("conv_id", F.row_number().over(place).alias("place"), F.xxhash64("role", "text").alias("a"),
                 F.xxhash64(F.lit(7), "text", "role").alias("b"), F.octet_length("text").alias("bytes"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct("a", "b", "bytes").alias("t")))).alias("l"))
    return t.select("conv_id", F.col("l.t").alias("turns"))


def opening_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(OPENINGS)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of every conversation: the opening of its group's first one, then its own turns after theirs."""
    c = written(turns_of(conversations), "turns")
    first = c.filter(F.pmod(F.col("conv_id"), F.lit(GROUP)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, OPENINGS - 1).alias("opening"))
    c = c.withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(GROUP))).withColumn("h", opening_length(F.col("conv_id")))
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return c.join(first, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("opening", F.lit(1), F.col("h")), none), own).alias("turns"))


# ------------------------------------------------------------------ one shard
#: Rows of a shard.  kind 0: a final node; 1: a part of a node that may go on; 2: ids that end at such a node.
SHARD = ("kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, bytes long, path long, key1 long, key2 long, parent1 long, parent2 long, part long, ids string")
_NAMES = [x.split()[0] for x in SHARD.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_ARROW = {x.split()[0]: _TYPES[x.split()[1]] for x in SHARD.split(", ")}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each prefix of a sequence of turns, the empty one first."""
    at = np.arange(1, len(a) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for x, y, salt in ((a, b, 1), (b, a, 2)):
        h = _mix(_mix(x.view(np.uint64) + at + np.uint64(salt)) ^ y.view(np.uint64))
        out.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(h)]).view(np.int64))
    return out[0], out[1]


def ordered(ranks: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows sorted by their sequences ``ranks[start:start + size]``, a prefix before what goes on, then by ``conv``."""
    order = np.lexsort((conv,))
    for lo in reversed(range(0, int(size.max(initial=0)), COLUMNS)):
        longer = size[order] > lo
        rows = order[longer]
        m = _matrix(ranks, start[rows], size[rows], lo)
        order = np.concatenate([order[~longer], rows[np.lexsort(m.T[::-1])]])       # both sorts are stable
    return order


def _matrix(ranks: np.ndarray, start: np.ndarray, size: np.ndarray, lo: int) -> np.ndarray:
    """Columns ``lo`` to ``lo + COLUMNS`` of the rows, padded by -1."""
    col = np.arange(lo, min(lo + COLUMNS, int(size.max(initial=lo))))
    inside = col[None, :] < size[:, None]
    at = np.where(inside, start[:, None] + col[None, :], 0)
    return np.where(inside, ranks[at], -1) if len(ranks) else np.zeros((len(size), 0), np.int64)


def node_starts(ranks: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sorted rows and each depth from 1: the rows that reach it, and which of them start a node."""
    rows = np.arange(len(size))
    changed = np.zeros(len(rows), bool)
    changed[:1] = True
    for lo in range(0, int(size.max(initial=0)), COLUMNS):
        longer = size[rows] > lo
        rows, changed = rows[longer], changed[longer]
        m = _matrix(ranks, start[rows], size[rows], lo)
        mask = np.ones(m.shape, bool)
        mask[1:] = m[1:] != m[:-1]
        mask |= changed[:, None]
        np.logical_or.accumulate(mask, axis=1, out=mask)
        for k in range(m.shape[1]):
            reach = m[:, k] >= 0
            yield rows[reach], mask[reach, k]
        changed = mask[:, -1] if m.shape[1] else changed


def shard_nodes(shard: int, conv: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, size_of: np.ndarray) -> Iterator[dict[str, object]]:
    """All rows of one shard, as columns: final nodes, parts of nodes on the first and last path, ids that end at those."""
    # ranks in the order of (a, b): equal turns have equal ranks
    by = np.lexsort((b, a))
    step = np.ones(len(a), np.int64)
    step[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    ranks = np.empty(len(a), np.int64)
    ranks[by] = np.cumsum(step) - 1
    start, size = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    order = ordered(ranks, start, size, conv)
    conv, start, size = conv[order], start[order], size[order]
    n = len(conv)
    breaks = np.append(np.flatnonzero(size[1:] != size[:-1]) + 1, n)

    def ending(first: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """The row after a node's last member that ends there: those members come first, in ascending order."""
        return np.where(size[first] == depth, np.minimum(end, breaks[np.searchsorted(breaks, first, "right")]), first)

    # per depth: first row, row after the last member, smallest member, bytes of the node's text
    levels = [(np.zeros(1, np.int64), np.full(1, n), conv.min(keepdims=True), np.zeros(1, np.int64))]
    for depth, (rows, new) in enumerate(node_starts(ranks, start, size), 1):
        at = np.flatnonzero(new)
        if not len(at):
            break
        count = np.diff(np.append(at, len(rows)))
        first = rows[at]
        levels.append((first, first + count, np.minimum.reduceat(conv[rows], at), size_of[start[first] + depth - 1].astype(np.int64)))

    # from the deepest level up: children, leaves and bytes saved of the nodes that are final
    path = [(int(size[0]), start[0]), (int(size[-1]), start[-1])]
    keys = [prefix_keys(a[s:s + d], b[s:s + d]) for d, s in path]
    results, parts = [], []
    below_first, below = np.zeros(0, np.int64), [np.zeros(1, np.int64)] * 3       # first rows and prefix sums (final children, leaves, saved)
    for depth in range(len(levels) - 1, -1, -1):
        first, end, low, text = levels[depth]
        count = end - first
        c0, c1 = np.searchsorted(below_first, first), np.searchsorted(below_first, end)
        children, leaves, saved = (x[c1] - x[c0] for x in below)
        open_ = (first == 0) | (end == n)
        all_children = children + 0
        if depth + 1 < len(levels):                                      # children that are open themselves
            up_first, up_end = levels[depth + 1][0], levels[depth + 1][1]
            for x in np.flatnonzero((up_first == 0) | (up_end == n)):
                all_children[np.searchsorted(first, up_first[x], "right") - 1] += 1
        leaves = leaves + (all_children == 0)
        saved = saved + (count - 1) * text
        done = ~open_
        if depth and done.any():
            up = levels[depth - 1]
            p = np.searchsorted(up[0], first[done], "right") - 1
            p_open = (up[0][p] == 0) | (up[1][p] == n)
            side = np.where(up[0][p] == 0, 0, 1)
            key = [np.where(side == 0, k0[min(depth - 1, len(k0) - 1)], k1[min(depth - 1, len(k1) - 1)]) for k0, k1 in zip(*keys, strict=True)]
            results.append({"depth": np.full(int(done.sum()), depth), "conv_id": low[done], "parent_conv_id": (up[2][p], ~p_open), "n_convs": count[done],
                            "n_children": all_children[done], "n_leaves": leaves[done], "saved_tokens": saved[done],
                            "ends_sha256": _ends(conv, first[done], ending(first[done], end[done], depth)),
                            "parent1": (key[0], p_open), "parent2": (key[1], p_open)})
        for x in np.flatnonzero(open_):
            side = 0 if first[x] == 0 else 1
            parts.append((depth, int(low[x]), int(count[x]), int(children[x]), int(leaves[x] - (all_children[x] == 0)), int(saved[x] - (count[x] - 1) * text[x]),
                          int(text[x]), side, int(first[x]), int(end[x])))
        below_first = first[done]
        below = [np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (np.ones(int(done.sum()), np.int64), leaves[done], saved[done])]

    for r in results:
        r["kind"] = np.zeros(len(r["depth"]), np.int32)
        yield r
    k = lambda side, depth, which: keys[side][which][depth]
    yield {"kind": np.ones(len(parts), np.int32), "depth": [p[0] for p in parts], "conv_id": [p[1] for p in parts], "n_convs": [p[2] for p in parts],
           "n_children": [p[3] for p in parts], "n_leaves": [p[4] for p in parts], "saved_tokens": [p[5] for p in parts], "bytes": [p[6] for p in parts],
           "path": [2 * shard + p[7] for p in parts], "key1": [k(p[7], p[0], 0) for p in parts], "key2": [k(p[7], p[0], 1) for p in parts],
           "parent1": [k(p[7], p[0] - 1, 0) if p[0] else None for p in parts], "parent2": [k(p[7], p[0] - 1, 1) if p[0] else None for p in parts],
           # the last path of the same shard, if the node spans it
           "part": [2 * shard + 1 if p[9] == n else 2 * shard for p in parts]}
    for p in parts:
        stop = int(ending(np.array([p[8]]), np.array([p[9]]), p[0])[0])
        for lo in range(p[8], stop, ID_BYTES // 21):
            yield {"kind": [2], "depth": [p[0]], "path": [2 * shard], "key1": [k(p[7], p[0], 0)], "key2": [k(p[7], p[0], 1)], "part": [lo],
                   "ids": [",".join(map(str, conv[lo:min(lo + ID_BYTES // 21, stop)].tolist()))]}


def _ends(conv: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[str]:
    """The hashes of the ids in some runs of rows."""
    return [hashlib.sha256(",".join(map(str, conv[lo:hi].tolist())).encode()).hexdigest() if hi > lo else EMPTY_SHA
            for lo, hi in zip(first.tolist(), end.tolist(), strict=True)]


def _batch(columns: dict[str, object]) -> pa.RecordBatch:
    n = len(columns["kind"])
    arrays = []
    for name in _NAMES:
        v = columns.get(name)
        if v is None:
            arrays.append(pa.nulls(n, _ARROW[name]))
        elif isinstance(v, tuple):
            arrays.append(pa.array(np.asarray(v[0]), _ARROW[name], mask=~np.asarray(v[1])))
        else:
            arrays.append(pa.array(v, _ARROW[name]))
    return pa.record_batch(arrays, names=_NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        turns = t.column(1).chunk(0)
        conv = t.column(0).to_numpy()
        flat = turns.flatten()
        a, b, size = (flat.field(i).to_numpy() for i in range(3))
        offsets = turns.offsets.to_numpy().astype(np.int64)
        for columns in shard_nodes(TaskContext.get().partitionId(), conv, offsets - offsets[0], a, b, size):
            yield _batch(columns)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key1, key2, depth, path, part, ids) to one hash a node."""
    now, sha = None, None
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
            if row[:3] != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = row[:3], hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(row[3].encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["key1", "key2", "depth", "ends_sha256"])
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=["key1", "key2", "depth", "ends_sha256"])


# ------------------------------------------------------------------ the trie
KEY = ["depth", "key1", "key2"]


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of ``conv_id, turns`` (``array<struct<a, b, bytes>>``, one row a conversation).

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    prepare(sequences.sparkSession)
    c = written(sequences.select("conv_id", F.col("turns").cast(f"array<{TURN}>").alias("turns")), "sequences")
    total = c.agg(F.sum(F.size("turns") + 1)).first()[0] or 0                    # one number
    dealt = c.repartitionByRange(max(1, -(-total // SHARD_TURNS)), F.transform("turns", lambda t: F.struct(t["a"], t["b"])), F.col("conv_id"))
    rows = written(dealt.mapInArrow(_shards, SHARD), "shards")
    final = rows.filter("kind = 0").select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent1", "parent2")

    # nodes on the first and last paths: parts of one prefix come together
    p = rows.filter("kind = 1")
    node = p.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("bytes").alias("bytes"), F.min("path").alias("path"), F.max("part").alias("last"),
        F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"))
    node = written(node, "path-nodes")
    under = node.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count("*").alias("more"))
    node = node.join(under, KEY, "left").withColumn("n_children", F.col("children") + F.coalesce("more", F.lit(0)))
    node = node.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes"))
    node = written(node, "path-sums")
    # a node's subtree: the deeper nodes of its own path, then all nodes of the paths up to its last one
    per_path = node.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sofar = W.orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    upto = written(per_path.select("path", F.sum("leaves").over(sofar).alias("leaves_to"), F.sum("saved").over(sofar).alias("saved_to")), "path-totals")
    deeper = W.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    node = node.withColumn("leaves", F.sum("leaves").over(deeper)).withColumn("saved", F.sum("saved").over(deeper))
    own = upto.select("path", F.col("leaves_to").alias("leaves_own"), F.col("saved_to").alias("saved_own"))
    # paths that started nothing have no row: the totals up to a node's last path are those of the latest path not after it
    marks = upto.select(F.col("path").alias("at"), "leaves_to", "saved_to", F.lit(None).cast("struct<depth: long, key1: long, key2: long>").alias("node")).unionByName(
        node.select(F.col("last").alias("at"), F.lit(None).cast("long").alias("leaves_to"), F.lit(None).cast("long").alias("saved_to"), F.struct(*KEY).alias("node")))
    blocks = _latest(marks)
    node = node.join(own, "path").join(blocks, KEY)
    node = node.select("depth", "key1", "key2", "conv_id", "parent1", "parent2", "n_convs", "n_children",
                       (F.col("leaves") + F.col("leaves_to") - F.col("leaves_own")).alias("n_leaves"),
                       (F.col("saved") + F.col("saved_to") - F.col("saved_own")).alias("saved_tokens"))

    ids = rows.filter("kind = 2").select("key1", "key2", "depth", "path", "part", "ids").repartition("key1", "key2").sortWithinPartitions("key1", "key2", "depth", "path", "part")
    ends = ids.mapInArrow(_hashed, "key1 long, key2 long, depth long, ends_sha256 string")
    node = written(node.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "path-result")

    parent = node.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_of"))
    open_ = node.select("depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent1", "parent2")
    every = final.unionByName(open_)
    named = every.filter("parent1 is null").drop("parent1", "parent2")            # the root, and nodes whose parent is final
    parent = checked_broadcast(parent, parent.count())
    others = every.filter("parent1 is not null").join(parent, ["depth", "parent1", "parent2"]).withColumn("parent_conv_id", F.col("parent_of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return named.select(columns).unionByName(others.select(columns))


def _latest(marks: DataFrame) -> DataFrame:
    """For each node row of ``marks`` the totals of the latest path at or before its ``at``.

    One row a path and one a node on a path: a few times the number of shards times
    their depth.  Two steps: inside runs of ``RUN`` paths, and over the runs' last values.
    """
    run = F.floor(F.col("at") / RUN).alias("run")
    m = marks.withColumn("run", run)
    before = W.partitionBy("run").orderBy("at", F.col("leaves_to").isNull()).rowsBetween(W.unboundedPreceding, 0)
    m = m.select("run", "node", F.last(F.when(F.col("leaves_to").isNotNull(), F.struct("leaves_to", "saved_to")), ignorenulls=True).over(before).alias("v"))
    of_run = marks.filter("node is null").withColumn("run", run).groupBy("run").agg(F.max_by(F.struct("leaves_to", "saved_to"), "at").alias("w"))
    runs = m.select("run").distinct().join(of_run, "run", "left")
    earlier = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("run", F.last("w", ignorenulls=True).over(earlier).alias("w"))
    m = m.filter("node is not null").join(runs, "run").select("node.*", F.coalesce("v", "w").alias("v"))
    return m.select(*KEY, "v.leaves_to", "v.saved_to")


RUN = 256


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the :func:`rebuilt` conversations."""
    prepare(conversations.sparkSession)
    return prefix_trie(rebuilt(conversations))
