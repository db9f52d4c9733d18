"""Connected components by alternating stars (large-star and small-star, Kiveris et al. 2014).

Every step is a grouped minimum and a join over the edges; nothing is gathered. Steps alternate
until the edges form stars around the least node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.llm.common import checkpointed, compact, few


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Large star: a node joins its larger neighbours to its least neighbour (or itself); small star:
    it joins its smaller neighbours and itself to the least of them. Neither makes more than the ``rows`` edges."""
    if large:
        pairs = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), rows)
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = few(pairs.groupBy("a").agg(F.min("b").alias("m")), rows)
    joined = few(pairs.join(least, "a"), rows)
    if large:
        new = joined.where("b > a").select("b", F.least("a", "m").alias("m"))
    else:
        new = few(joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")), rows)
    return few(new.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), rows)


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """``node`` and ``root`` (the component's least node) of each node with an edge.

    ``edges``: columns a and b, of any number type; loops and repeated edges do no harm.
    """
    edges = compact(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, state = edges.count(), None
    for _ in range(steps):
        edges = checkpointed(_star(_star(edges, True, rows), False, rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return few(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), 2 * rows)
