"""Connected components of an edge table: alternating large and small stars.

Every step is a grouped minimum and a join, so a hub with any number of edges
is pre-aggregated before its shuffle and its join can be split.  Rounds are
written to the shared checkpoint folder; their number grows with the logarithm
of the graph's size.  One grouped count sees when all components are stars, so
no round is run to find that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import written


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its smallest neighbour or itself."""
    both = _both(e)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b").distinct())


def _small(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _starred(e: DataFrame) -> bool:
    """Whether every larger end has one edge and is no edge's smaller end: then the smaller ends are the components."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max(F.expr("up > 1 or up = 1 and down = 1"))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every node of ``edges`` but the components' own smallest ids.

    ``edges``: two integer columns, in any direction, repeated or not; nulls and
    loops are left out.  An id that isn't in the result is its own component.
    An empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _starred(e):
        e = written(_small(_large(e)), "edges")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
