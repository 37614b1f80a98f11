"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round hangs the larger neighbours of a node on its smallest one (large
    star), then the smaller ones likewise (small star).  Hubs are no problem: a
    node's neighbours are only aggregated and joined, never collected.  Rounds
    end when the edges stay as they are, which makes them stars.
    """
    hung = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    hung, before = staged(hung), None
    while True:
        both = hung.union(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        hung = staged(small.select("e.*").where("a <> b").distinct())
        after = tuple(hung.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if after == before or after[0] == 0:
            break
        before = after
    roots = hung.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(hung.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
