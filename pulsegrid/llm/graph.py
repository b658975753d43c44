"""Connected components of an edge table by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the least node it reaches.

    Each round is written to the shared folder; a node of many edges is split by the join."""
    now = cut(edges.where(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.col("k"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(least, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = (large.join(least, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("k", "m")))
        now = cut(small.distinct())
    return (now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .union(now.select(F.col("v"), F.col("v")).distinct()))
