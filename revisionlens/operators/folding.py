"""The pieces of split and merged sentences brought together, by a containment forest.

A row of an edit cluster that has text on one side only is a *piece*.  A piece
that is nearly contained (D8) in the other side's text of another row points to
that row; the arrows make a forest, every piece goes to its tree's root in one
step, and rounds repeat on the merged texts until no arrow is left.

* Direction.  Arrows go from shorter to longer texts, or to rows with both sides,
  which never move.  Between two pieces of equal length (contained in each other or
  only one way) it is always the old one that moves to the new one's row.  So
  arrows never close a circle, and of two pieces that contain each other one moves.
* Choice.  Of several rows the piece takes the one that holds the largest share
  of its words, then the nearest, then the lowest.
* Roots are found by pointer jumping: each step doubles the distance that every
  piece has looked ahead, so a chain of k pieces takes log2(k) joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisionlens.functions import constants as K
from revisionlens.functions import text as X
from revisionlens.operators.matching import group_starts, whole_articles
from revisionlens.session import materialize

PAIR = ["source", "entry_id", "version_x", "version_y"]
CLUSTER = PAIR + ["cluster_id"]


def contained(pieces: DataFrame, containers: DataFrame, slack: float) -> DataFrame:
    """``CLUSTER, i, j, m, l1, l2``: of ``pieces`` (CLUSTER, j, w2, l2) and ``containers`` (CLUSTER, i, w1, l1) of a
    cluster the pairs i != j, l2 <= l1, with ``m >= l2 * (1 - slack)`` of the words w2 in w1.

    A prefix filter makes the candidates: at most ``l2 * slack`` words may be
    missing, so one of any ``floor(l2 * slack) + 1`` of them must be in the
    container; those found in the fewest containers are taken, so a word that
    all rows of a cluster share joins nothing unless the text has no rarer ones.
    Pieces without words aren't looked at here.
    """
    e1 = containers.select(*CLUSTER, "i", "l1", F.explode(F.array_distinct("w1")).alias("w"))
    often = e1.groupBy(*CLUSTER, "w").agg(F.count("*").alias("often"))
    e2 = pieces.select(*CLUSTER, "j", "l2", F.posexplode("w2").alias("pos", "w")).join(often, CLUSTER + ["w"], "left")
    rare = Window.partitionBy(*CLUSTER, "j").orderBy(F.coalesce("often", F.lit(0)), "w", "pos")
    prefix = (e2.withColumn("rank", F.row_number().over(rare)).filter((F.col("rank") <= F.floor(F.col("l2") * slack) + 1) & F.col("often").isNotNull())
                .select(*CLUSTER, "j", "l2", "w").distinct())
    cand = prefix.join(e1, CLUSTER + ["w"]).filter((F.col("i") != F.col("j")) & (F.col("l2") <= F.col("l1"))).select(*CLUSTER, "i", "j").distinct()
    both = cand.join(pieces.select(*CLUSTER, "j", "w2", "l2"), CLUSTER + ["j"]).join(containers.select(*CLUSTER, "i", "w1", "l1"), CLUSTER + ["i"])
    m = F.size(F.filter("w2", lambda w: F.array_contains("w1", w))).cast("long")
    return both.select(*CLUSTER, "i", "j", m.alias("m"), "l1", "l2").filter(F.col("m") >= F.col("l2") * (1 - slack))


def held_words(w2: list[str], has: frozenset[str], slack: float) -> int | None:
    """How many of the words w2 the text with the words ``has`` holds, if that is enough (:func:`contained`; no words are in every text)."""
    m = sum(w in has for w in w2)
    return m if not w2 or m and m >= len(w2) * (1 - slack) else None


def _arrows(rows: DataFrame, slack: float, max_words: int | None) -> DataFrame:
    """``CLUSTER, src, dst, share``: where each piece may go."""
    words = lambda side: X.content_words(X.tokens(F.array_join(F.col(f"{side}.text"), " ")))
    rows = rows.select(*CLUSTER, "row_idx", F.size("old").alias("n_old"), F.size("new").alias("n_new"), words("old").alias("w_old"), words("new").alias("w_new"))
    rows = materialize(rows.withColumn("alone", (F.col("n_old") == 0) | (F.col("n_new") == 0)), "fold-rows")
    found = []
    for mine, other in (("old", "new"), ("new", "old")):
        piece = rows.filter(F.col("alone") & (F.col(f"n_{mine}") > 0)).select(*CLUSTER, F.col("row_idx").alias("j"), F.col(f"w_{mine}").alias("w2"), F.size(f"w_{mine}").alias("l2"))
        if max_words is not None:
            piece = piece.filter(F.col("l2") <= max_words)
        box = rows.filter(F.col(f"n_{other}") > 0).select(*CLUSTER, F.col("row_idx").alias("i"), F.col(f"w_{other}").alias("w1"), F.size(f"w_{other}").alias("l1"), "alone")
        hits = contained(piece.filter("l2 > 0"), box, slack).join(box.select(*CLUSTER, "i", "alone"), CLUSTER + ["i"])
        turned = (F.col("alone") & (F.col("l1") == F.col("l2"))) if mine == "new" else F.lit(False)
        found.append(hits.select(*CLUSTER, F.when(turned, F.col("i")).otherwise(F.col("j")).alias("src"),
                                 F.when(turned, F.col("j")).otherwise(F.col("i")).alias("dst"), (F.col("m") / F.col("l2")).alias("share")))
        # a piece without content words is in every text: it goes to the nearest row
        empty = piece.filter("l2 = 0").select(*CLUSTER, F.col("j").alias("row_idx"), F.lit(True).alias("empty"))
        fits = F.col(f"n_{other}") > 0
        if mine == "new":
            fits = fits & (~F.col("alone") | (F.size("w_old") > 0))
        near = rows.join(empty.select(*CLUSTER).distinct(), CLUSTER, "left_semi").join(empty, CLUSTER + ["row_idx"], "left")
        at = F.when(fits, F.col("row_idx"))
        before = Window.partitionBy(*CLUSTER).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*CLUSTER).orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("lo", F.last(at, ignorenulls=True).over(before)).withColumn("hi", F.last(at, ignorenulls=True).over(after)).filter("empty")
        closer = F.col("lo").isNull() | (F.col("hi") - F.col("row_idx") < F.col("row_idx") - F.col("lo"))
        near = near.select(*CLUSTER, F.col("row_idx").alias("src"), F.when(closer, F.col("hi")).otherwise(F.col("lo")).alias("dst"), F.lit(0.0).alias("share"))
        found.append(near.filter("dst is not null"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _roots(best: DataFrame) -> DataFrame:
    """``CLUSTER, src, root`` of a forest ``CLUSTER, src, dst``, by pointer jumping."""
    now = materialize(best, "fold-arrows")
    while True:
        step = now.select(*CLUSTER, F.col("src").alias("dst"), F.col("dst").alias("further"))
        jumped = now.join(step, CLUSTER + ["dst"], "left")
        if not jumped.filter("further is not null").head(1):
            return now.withColumnRenamed("dst", "root")
        now = materialize(jumped.select(*CLUSTER, "src", F.coalesce("further", "dst").alias("dst")), "fold-arrows")


def folded_rows(rows: list[int], words: tuple[list, list], slack: float, max_words: int | None) -> dict[int, list[int]]:
    """The fold of one cluster: each row that is left -> the places of the rows it is made of, in order (nothing if no row moved).

    ``rows``: row numbers, increasing; ``words``: both sides' words by place, None for a side without text.
    """
    made = {r: [at] for at, r in enumerate(rows)}
    while True:
        def side(k, made=made):
            texts = ((r, [words[k][at] for at in places if words[k][at] is not None]) for r, places in made.items())
            return {r: [w for t in some for w in t] for r, some in texts if some}
        sides = side(0), side(1)
        best: dict[int, tuple[float, int, int]] = {}
        for mine, other in ((0, 1), (1, 0)):
            boxes = [(i, w1, frozenset(w1)) for i, w1 in sides[other].items()]
            for j, w2 in sides[mine].items():
                if j in sides[other] or max_words is not None and len(w2) > max_words:
                    continue
                found = []
                if w2:
                    for i, w1, has in boxes:
                        m = held_words(w2, has, slack) if len(w2) <= len(w1) else None
                        if m is not None:
                            turned = mine == 1 and i not in sides[1] and len(w1) == len(w2)
                            found.append((i, j, m / len(w2)) if turned else (j, i, m / len(w2)))
                else:
                    fits = [i for i, w1, _ in boxes if mine == 0 or i in sides[1] or w1]
                    near = [max((i for i in fits if i < j), default=None), min((i for i in fits if i > j), default=None)]
                    found = [(j, min((abs(i - j), i) for i in near if i is not None)[1], 0.0)] if fits else []
                for src, dst, share in found:
                    arrow = (-share, abs(src - dst), dst)
                    best[src] = min(best.get(src, arrow), arrow)
        if not best:
            return made if len(made) < len(rows) else {}
        after: dict[int, list[int]] = {}
        for r, places in made.items():
            while r in best:
                r = best[r][2]
            after.setdefault(r, []).extend(places)
        made = {r: sorted(places) for r, places in after.items()}


def _fold_together(slack: float, max_words: int | None):
    """Whole clusters' rows, with the words of those that aren't alone -> folded rows."""
    def run(batches):
        for t in whole_articles(batches, CLUSTER):
            many = np.flatnonzero(t.column("cluster_rows").to_numpy() > 1)
            if not len(many):
                yield from t.select(_FOLDED.names).cast(_FOLDED).to_batches()
                continue
            some = t.take(pa.array(many)).combine_chunks()
            row, words = some.column("row_idx").to_pylist(), [some.column(c).to_pylist() for c in ("w_old", "w_new")]
            edges = [*group_starts(some, CLUSTER).tolist(), some.num_rows]
            stay, moved = np.ones(t.num_rows, bool), []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                made = folded_rows(row[lo:hi], (words[0][lo:hi], words[1][lo:hi]), slack, max_words)
                if made:
                    stay[many[lo:hi]] = False
                    moved += [(lo + places[0], r, [lo + at for at in places]) for r, places in made.items()]
            yield from t.select(_FOLDED.names).filter(pa.array(stay)).cast(_FOLDED).combine_chunks().to_batches()
            if moved:
                sides = {c: some.column(c).to_pylist() for name in ("old", "new") for c in (f"sent_idx_{name}", f"text_{name}", f"tag_{name}")}
                keys = some.select(CLUSTER).take(pa.array([at for at, _, _ in moved])).combine_chunks()
                out = {c: keys.column(c).combine_chunks() for c in CLUSTER} | {"row_idx": pa.array([r for _, r, _ in moved], pa.int32())}
                for k, name in enumerate(("old", "new")):
                    here = [[at for at in places if words[k][at] is not None] for _, _, places in moved]
                    idx, text, tag = (sides[f"{c}_{name}"] for c in ("sent_idx", "text", "tag"))
                    out[f"sent_idx_{name}"] = pa.array([[i for at in h for i in idx[at]] for h in here], _FOLDED.field(f"sent_idx_{name}").type)
                    out[f"text_{name}"] = pa.array([" ".join(text[at] for at in h) for h in here], pa.string())
                    out[f"tag_{name}"] = pa.array([max((tag[at] for at in h), default=" ") for h in here], pa.string())
                yield pa.record_batch([out[c] for c in _FOLDED.names], schema=_FOLDED)
    return run


_FOLDED = pa.schema([("source", pa.string()), ("entry_id", pa.int64()), *[(c, pa.int32()) for c in ("version_x", "version_y", "row_idx")],
                     *[(f"{c}_{name}", kind) for name in ("old", "new") for c, kind in (("sent_idx", pa.list_(pa.int32())), ("text", pa.string()), ("tag", pa.string()))],
                     ("cluster_id", pa.int32())])


def _folded_together(clustered: DataFrame, slack: float, max_words: int | None) -> DataFrame:
    """D9 where the clusters' rows lie together: rows of one-row clusters pass as they are, the others are folded in their task."""
    cols = [*CLUSTER, "row_idx", "cluster_rows"]
    for name in ("old", "new"):
        text = F.col(f"text_{name}")
        has, idx = text != "", F.array(f"sent_idx_{name}")
        cols += [F.when(has, idx).otherwise(F.slice(idx, 1, 0)).alias(f"sent_idx_{name}"), F.when(has, F.trim(text)).otherwise("").alias(f"text_{name}"), f"tag_{name}",
                 F.when(has & (F.col("cluster_rows") > 1), X.content_words(X.tokens(text))).alias(f"w_{name}")]
    rows = clustered.filter("text_old != '' or text_new != ''").select(*cols)
    return rows.mapInArrow(_fold_together(slack, max_words), "source string, entry_id long, version_x int, version_y int, row_idx int, sent_idx_old array<int>, text_old string, "
                                                             "tag_old string, sent_idx_new array<int>, text_new string, tag_new string, cluster_id int")


def merge_split_sentences(clustered: DataFrame, slack: float = K.CONTAINMENT_SLACK, max_words: int | None = None) -> DataFrame:
    """D9 over the rows of ``edit_clusters``: containment folded until nothing changes (see the module's text).

    Each row's texts of a side are joined in the order of the rows they came from, and the
    indices of their sentences are kept in that order (arrays); rows left without
    text are gone.  Clusters in which nothing moved aren't looked at again.
    Returns ``PAIR, row_idx, sent_idx_old, text_old, tag_old, sent_idx_new, text_new, tag_new, cluster_id``.

    Rows that were aligned by a rule (:func:`diff.sentence_diff_set`) are folded where they lie, cluster by cluster; only those of large
    version pairs go through joins.
    """
    if "cluster_rows" in clustered.columns:
        here, rest = clustered.filter("not joined"), clustered.filter("joined")
        here = _folded_together(here, slack, max_words)
        return here.unionByName(merge_split_sentences(rest.drop("cluster_rows", "joined"), slack, max_words)) if rest.head(1) else here

    def side(name):
        one = F.struct("row_idx", F.trim(f"text_{name}").alias("text"), F.col(f"sent_idx_{name}").alias("sent_idx"))
        return F.when(F.col(f"text_{name}") != "", F.array(one)).otherwise(F.slice(F.array(one), 1, 0)).alias(name)

    # counted in the order that the clusters were numbered in, so the texts aren't dealt out again
    cluster = Window.partitionBy(*CLUSTER)
    rows = clustered.filter("text_old != '' or text_new != ''").withColumn("open", (F.count("*").over(cluster) > 1) & F.max(~F.coalesce((F.col("text_old") != "") & (F.col("text_new") != ""), F.lit(False))).over(cluster))
    rows = materialize(rows.select(*CLUSTER, "row_idx", side("old"), "tag_old", side("new"), "tag_new", "open"), "fold")
    open_, done = rows.filter("open").drop("open"), [rows.filter("not open").drop("open")]
    while True:
        arrows = _arrows(open_, slack, max_words)
        rank = Window.partitionBy(*CLUSTER, "src").orderBy(F.desc("share"), F.abs(F.col("src") - F.col("dst")), "dst")
        best = arrows.withColumn("place", F.row_number().over(rank)).filter("place = 1").select(*CLUSTER, "src", "dst")
        roots = _roots(best)
        if not roots.head(1):
            done.append(open_)
            break
        moving = roots.select(*CLUSTER).distinct()
        done.append(open_.join(moving, CLUSTER, "left_anti"))
        m = open_.join(moving, CLUSTER, "left_semi").join(roots.withColumnRenamed("src", "row_idx"), CLUSTER + ["row_idx"], "left")
        m = m.groupBy(*CLUSTER, F.coalesce("root", "row_idx").alias("row_idx")).agg(
            F.array_sort(F.flatten(F.collect_list("old"))).alias("old"), F.max(F.when(F.size("old") > 0, F.col("tag_old"))).alias("tag_old"),
            F.array_sort(F.flatten(F.collect_list("new"))).alias("new"), F.max(F.when(F.size("new") > 0, F.col("tag_new"))).alias("tag_new"))
        open_ = materialize(m.select(*CLUSTER, "row_idx", "old", F.coalesce("tag_old", F.lit(" ")).alias("tag_old"), "new", F.coalesce("tag_new", F.lit(" ")).alias("tag_new")), "fold")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*PAIR, "row_idx", F.col("old.sent_idx").alias("sent_idx_old"), F.array_join("old.text", " ").alias("text_old"), "tag_old",
                      F.col("new.sent_idx").alias("sent_idx_new"), F.array_join("new.text", " ").alias("text_new"), "tag_new", "cluster_id")
