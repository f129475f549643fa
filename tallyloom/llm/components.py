"""Connected components of a graph by alternating large and small stars.

Each star is a partial aggregate and a join, so a vertex with very many links is not gathered in one task. Rounds are
written to the shared scratch folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each vertex u (larger ones, or those up to u) to the smallest of all of them.

    Large: every larger neighbour v gets (v, m). Small, on edges that point to smaller vertices: every v and u itself get
    (v, m). ``edges`` are pairs (a, b).
    """
    if large:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(lowest, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(vertex, root): the smallest vertex that each vertex of an edge can reach. ``edges``: longs (a, b), a <> b.

    Vertices that are their own root are not listed. Ends when a round changes nothing; raises if that takes too long.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "stars")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count(F.when(F.col("b") >= F.col("a"), 1))
        ).first()
        if state == before:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components: not settled after {rounds} rounds")
