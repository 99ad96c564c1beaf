"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _linked(edges: DataFrame, own: str, other: str) -> DataFrame:
    """Edges with ``least``: the smallest of a node and its listed neighbours."""
    least = edges.groupBy(own).agg(F.least(F.min(other), F.col(own)).alias("least"))
    return edges.join(least, own)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``; ``root`` is the smallest node connected to it.

    Each round hangs larger neighbours on the smallest one seen, first among all neighbours, then among the smaller;
    the number of edges never grows, and paths at least halve. Rounds are staged, so lineage stays short.
    """
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _linked(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        small = _linked(large, "a", "b")
        small = small.select("a", F.col("least").alias("b")).union(small.select(F.col("b").alias("a"), F.col("least").alias("b")))
        current = stage(small.filter("a <> b").distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = current.select(F.col("b").alias("node")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        seen = now
    raise RuntimeError("components did not settle")
