"""Connected components of an edge table, by alternating star contraction.

Large-star and small-star rounds (Kiveris et al., 2014) run as joins against a
grouped minimum, which combines on the map side; every round is written to the
checkpoint folder. Nothing is gathered per vertex, so a vertex with very many
neighbours is only a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b), of any orderable type, -> (id, component) for every id that has an edge to another.

    component is the smallest id that can be reached. Loops and repeated edges have
    no effect.
    """
    stars = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(lowest, both.a == lowest.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.withColumnRenamed("a", "k"), large.a == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = checkpoint(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        now = _state(stars)
        if now == before:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
    if before[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
