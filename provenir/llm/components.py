"""Connected components of links between long ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (a, b): everything next to a is hung on a's least.

    The minimum is a partial aggregate, written and joined back: a hub's rows never have to
    meet in one task, since Spark can split a busy key of that join.  ``edges`` is written.
    It is a merge join at every size: nodes have no bound, so the driver may not hold them.
    """
    least = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    met = edges.join(least.hint("merge"), "a")
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node.

    Raises if the links don't settle within ``rounds`` (they take about log n).
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = materialize(_star(both, True).filter("a != b").distinct(), "hung")
        # small stars look at each node's lower neighbours only
        edges = materialize(_star(hung, False).filter("a != b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
