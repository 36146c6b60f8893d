"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import stage


def components(links: DataFrame) -> DataFrame:
    """Columns node and root, the smallest node of its component, for every node of ``links`` (a, b).

    Each round joins every node's neighbours to the smallest of them, first over larger neighbours,
    then over smaller ones, so that components shrink to stars in a logarithmic number of rounds.
    Rounds are written to the shared folder. A node with very many neighbours is merged before the
    shuffle, and its join has one row on the other side. Null ends and loops are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = stage(pairs.distinct(), "links"), None
    while True:
        # bit_xor and sum of hashes tell two sets of edges apart; both are one row
        mark = F.xxhash64("u", "v")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.cast("decimal(20)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.union(below).distinct(), "links")
