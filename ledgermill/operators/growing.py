"""Entities of a growing input: what is known is kept, and a new file adds only its own links.

Kept are the root of each wallet, one anchor wallet for each address and transaction, and the last rows, with which
new ones can form a pass-through. New star edges are drawn between roots, so that the components to be found are
those of the changes, however large the whole is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..settings import DEFAULTS
from .components import connected_components
from .linkage import pass_through_edges


@dataclass
class Known:
    """roots(wallet, root), anchors(kind, key, wallet) and recent (transactions of the last ``gap_s`` seconds)."""

    roots: DataFrame
    anchors: DataFrame
    recent: DataFrame

    def entities(self, *, full_ids: bool = False) -> DataFrame:
        """(wallet, entity_id), as ``linkage.wallet_entities`` names them."""
        name = F.col("root") if full_ids else F.substring("root", 1, DEFAULTS.entity_id_chars)
        return self.roots.select("wallet", F.concat(F.lit("entity_"), name).alias("entity_id"))

    def save(self, folder: str) -> None:
        for part in ("roots", "anchors", "recent"):
            getattr(self, part).write.mode("error").parquet(f"{folder}/{part}.parquet")


def load(spark: SparkSession, folder: str) -> Known:
    return Known(*(spark.read.parquet(f"{folder}/{part}.parquet") for part in ("roots", "anchors", "recent")))


def nothing(tx: DataFrame) -> Known:
    """What is known before the first file, for transactions like ``tx``."""
    spark = tx.sparkSession
    return Known(spark.createDataFrame([], "wallet string, root string"), spark.createDataFrame([], "kind string, key string, wallet string"), tx.limit(0))


def extend(known: Known, tx: DataFrame, *, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention) -> Known:
    """``known`` with the transactions of a new file, all later than those known.

    A transfer that comes late could take the place of one that a known pass-through rests on, and a
    component is never split again: such a file is refused with a ValueError, and needs a run over everything.
    """
    tx = materialize(tx.select(*known.recent.columns))
    ends = lambda df: df.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    new, old = ends(tx), ends(known.recent)
    if new.first is None:
        return known
    if old.last is not None and new.first <= old.last:
        raise ValueError(f"the new transactions begin at {new.first}, when others up to {old.last} are known")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"), F.col("src_wallet").alias("wallet"))
    held = tx.select(F.explode(F.array(key("ip", "broadcast_ip"), key("tx", "tx_id"))).alias("h")).select("h.*").where("key is not null").distinct().unionByName(known.anchors)
    anchors = materialize(held.groupBy("kind", "key").agg(F.min("wallet").alias("wallet")))
    shared = held.join(anchors.withColumnRenamed("wallet", "b"), ["kind", "key"]).where("wallet <> b").select(F.col("wallet").alias("a"), "b")
    together = known.recent.unionByName(tx)
    links = materialize(shared.unionByName(pass_through_edges(together, gap_s, retention)).distinct())
    touched = tx.select(F.explode(F.array("src_wallet", "dst_wallet")).alias("wallet")).unionByName(links.select(F.explode(F.array("a", "b")).alias("wallet"))).distinct()
    roots = touched.join(known.roots, "wallet", "left").select("wallet", F.coalesce("root", "wallet").alias("root"))
    roots = materialize(roots)
    of = lambda c: roots.select(F.col("wallet").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    changed = connected_components(between).select(F.col("id").alias("root"), "component")
    everything = known.roots.unionByName(roots.join(known.roots, "wallet", "left_anti"))
    grown = everything.join(changed, "root", "left").select("wallet", F.coalesce("component", "root").alias("root"))
    last = F.lit(new.last)
    recent = together.where(F.col("timestamp") > last - F.make_dt_interval(secs=F.lit(gap_s + 1)))
    return Known(materialize(grown), anchors, materialize(recent))
