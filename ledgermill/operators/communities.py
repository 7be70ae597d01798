"""Communities by parallel Louvain rounds, and how isolated an entity's community is.

A round sums for each node the weight it has towards each neighbouring community, and moves it where modularity gains most. Half of
the nodes, by a hash, may move in a round and the others in
the next, so that two neighbours do not swap for ever; ties go to the smaller community. A level ends with a pair of rounds whose
moves gain next to nothing, or hardly less than those of the pair before (moves that undo each other).
Then communities become nodes, and the next level begins, until modularity stops rising.

Nodes are whole numbers while they move, and rounds run over packed arrays (``moves``): in blocks of nodes, and in one task once few edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import moves
from .scaling import min_max


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """edges(a, b, w) undirected without repeats, communities(id, community)."""
    total = edges.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    ca, cb = communities.select(F.col("id").alias("a"), F.col("community").alias("ca")), communities.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    both = edges.join(ca, "a").join(cb, "b")
    inside = both.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] / total
    degree = both.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    return float(inside - degree.agg(F.sum((F.col("d") / (2 * total)) ** 2)).first()[0])


def _numbered(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes(id, key)): edges between keys, hashes that no two nodes share; the seed rises until that is so."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    while True:
        key = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        keyed = materialize(nodes.select("id", key("id").alias("key")))
        if keyed.groupBy("key").count().where("count > 1").isEmpty():
            return materialize(edges.select(key("a").alias("a"), key("b").alias("b"))), keyed
        seed += 1


def louvain(pairs: DataFrame, *, seed: int = 42, least_gain: float = 1e-4) -> DataFrame:
    """pairs(a, b), an undirected graph -> (id, community): each community is named after its smallest node. Loops and repeats have no effect.

    ``least_gain`` is the modularity that a pair of rounds, and a level, must add to be followed by another. ``pairs`` is read twice.
    """
    ship(pairs.sparkSession)
    edges, nodes = _numbered(pairs.where("a <> b"), seed)
    if edges.isEmpty():
        return nodes.select("id", F.col("id").alias("community"))
    levels = moves.levels(edges, seed=seed, least_gain=least_gain)
    parts = levels[-1]
    for lower in reversed(levels[:-1]):
        parts = lower.join(parts.select(F.col("id").alias("c"), F.col("c").alias("top")), "c").select("id", F.col("top").alias("c"))
    member = materialize(nodes.join(parts.withColumnRenamed("id", "key"), "key").select("id", "c"))
    names = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(names, "c").select("id", "community")


def entity_isolation(entities: DataFrame, communities: DataFrame) -> DataFrame:
    """(entity_id, community_isolation_score): the largest of 1 / community size over an entity's wallets, scaled from 0 to 1.

    Sizes count wallets only. A wallet without a community stands alone.
    """
    wallets = communities.where(F.col("id").startswith("Wallet:")).select(F.substring("id", 8, 1_000_000).alias("wallet"), "community")
    sizes = wallets.groupBy("community").agg(F.count("*").alias("size"))
    placed = entities.join(wallets.join(sizes, "community").select("wallet", "size"), "wallet", "left")
    raw = placed.groupBy("entity_id").agg(F.max(1.0 / F.coalesce("size", F.lit(1))).alias("raw"))
    return min_max(raw, "raw", "community_isolation_score").select("entity_id", "community_isolation_score")
