"""Connected components by contraction, with every round in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """``vertex, root`` of each end of ``links`` (``a, b`` long): equal roots, same component.

    In a round every vertex points to the neighbour (or itself) with the smallest hash,
    links are drawn anew between those, and links within one are gone. Hashes change
    from round to round, so that no order of the vertices is a bad one and the number
    of rounds grows as the logarithm of the input. Pointers are minima, combined in
    the tasks before the shuffle; joins are plain ones of two written tables, which
    Spark splits at hubs.
    """
    links = materialize(links.where("a <> b").select("a", "b"), "links")
    roots, turn = None, 0
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("v")))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("v"))
        points = materialize(both.groupBy("a").agg(least.alias("least")).select(F.col("a").alias("v"), F.least("least", own)["v"].alias("p")), "points")
        if roots is None:
            roots = points.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
        else:
            roots = roots.join(points, roots["root"] == points["v"], "left").select("vertex", F.coalesce("p", "root").alias("root"))
            roots = materialize(roots, "roots")
        to_a = points.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to_b = points.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        between = links.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        links = materialize(between.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if links.limit(1).count() == 0:
            return roots
        turn += 1
