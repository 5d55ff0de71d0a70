"""Connected components by alternating large-star and small-star rewiring (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage, shuffles_freed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) longs -> (node, root) with the smallest node reachable, for nodes that have an edge.

    Each round hangs every node's larger neighbours on its smallest one, then does the same for smaller neighbours;
    the number of rounds grows with the logarithm of the longest chain. It ends as soon as no node hangs on two others
    or on one that hangs itself. Only aggregates and joins over edges are used, the driver sees one count a round. Self
    loops and repeated edges are allowed.
    """
    stars = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        with shuffles_freed(stars.sparkSession):
            both = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0))])
            ends = stars.select(F.explode(both).alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.sum("end.down").alias("down"))
            unsettled = ends.filter("up > 1 or (up > 0 and down > 0)").agg(F.count(F.lit(1))).first()[0]
        if not unsettled:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        larger = stars.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = stars.unionByName(larger)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
