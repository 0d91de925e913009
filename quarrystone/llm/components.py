"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From (a, b) to (u, v): v is the smallest node that u, another node, is connected with.

    Each round works on the edge table alone, with minima combined before they are
    shuffled, and writes it; a node of many edges is no unit of work."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stored(edges.where("a <> b").select(u, v).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            return edges
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        was, edges = edges, stored(small, "edges")
        before, mark = mark, _mark(edges)
        dropped(was)
        if mark == before:
            return edges
    raise RuntimeError(f"components don't settle in {most_rounds} rounds")
