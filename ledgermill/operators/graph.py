"""The property graph of transfers: vertices and edges as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_few, checkpoint

KINDS = ("Wallet", "Transaction", "IP", "ASN")


def node_id(kind: str, column):
    return F.concat(F.lit(f"{kind}:"), column)


def vertices(tx: DataFrame) -> DataFrame:
    """(id, kind, timestamp, amount_btc, asn), one row per id; of a repeated transaction the last row's values."""
    none_t, none_a, none_s = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double"), F.lit(None).cast("string")
    node = lambda kind, c, t=none_t, a=none_a, s=none_s: F.struct(node_id(kind, F.col(c)).alias("id"), F.lit(kind).alias("kind"), t.alias("timestamp"), a.alias("amount_btc"), s.alias("asn"))
    each = F.array(node("Wallet", "src_wallet"), node("Wallet", "dst_wallet"), node("Transaction", "tx_id", F.col("timestamp"), F.col("amount_btc")), node("IP", "broadcast_ip"), node("ASN", "asn", s=F.col("asn")))
    rows = tx.select(F.explode(each).alias("n")).select("n.*")
    last = F.max(F.struct("timestamp", "amount_btc", "asn")).alias("v")
    return rows.groupBy("id", "kind").agg(last).select("id", "kind", "v.*")


def edges(tx: DataFrame) -> DataFrame:
    """(src, dst, kind, tx_id), four per row and none merged."""
    w = lambda c: node_id("Wallet", F.col(c))
    t, ip, asn = node_id("Transaction", F.col("tx_id")), node_id("IP", F.col("broadcast_ip")), node_id("ASN", F.col("asn"))
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    each = F.array(edge(w("src_wallet"), t, "sends"), edge(t, w("dst_wallet"), "receives"), edge(t, ip, "broadcast_from"), edge(ip, asn, "belongs_to"))
    return tx.select("tx_id", F.explode(each).alias("e")).select("e.*", "tx_id")


def nodes_of_kind(v: DataFrame, kind: str) -> DataFrame:
    return v.where(F.col("kind") == kind)


def wallet_transactions(e: DataFrame, wallets: DataFrame) -> DataFrame:
    """wallets(wallet) -> (wallet, tx): the distinct transactions that each sends or receives."""
    keys = wallets.select(F.col("wallet"), node_id("Wallet", F.col("wallet")).alias("_w")).distinct()
    sent = e.where("kind = 'sends'").select(F.col("src").alias("_w"), F.col("dst").alias("tx"))
    received = e.where("kind = 'receives'").select(F.col("dst").alias("_w"), F.col("src").alias("tx"))
    return sent.union(received).join(keys, "_w").select("wallet", "tx").distinct()


def simple_projection(e: DataFrame) -> DataFrame:
    """(a, b) with a < b: directions and parallel edges dropped."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(id, degree), parallel edges counted."""
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced_edges(e: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose ends both are in ids(id)."""
    a, b = ids.select(F.col("id").alias("src")).distinct(), ids.select(F.col("id").alias("dst")).distinct()
    return e.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*e.columns)


def neighbourhood(e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop): all nodes within ``hops`` undirected steps of seeds(id), seeds at 0.

    Seeds without any edge stay. Each hop is a semi-join of the frontier; the seeds are few, so
    adaptive execution broadcasts them as long as they measure small.
    """
    near = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    for hop in range(1, hops + 1):
        frontier = near.where(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        step = both.join(frontier, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        near = near.unionByName(step.join(near, "id", "left_anti").withColumn("hop", F.lit(hop)))
    return near


#: Members whose neighbourhoods one whole number carries as bits.
BITS = 63


def neighbourhoods(e: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seeds(member, id), member a number from 0 -> (block, id, bits, hop): who reaches a node first at which hop.

    Bit m of a row of block b stands for member 63 b + m. All members walk together: a hop joins the edges once for each
    block, so that a hub is expanded once however many members have come to it, and what arrives
    is combined by bitwise or before it is shuffled. One job for each hop, over edges that are shuffled only if the frontier is large.
    """
    step_of = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = e.select(F.explode(F.array(step_of("src", "dst"), step_of("dst", "src"))).alias("s")).select("s.*")
    bit = F.expr(f"shiftleft(1L, cast(member % {BITS} as int))")
    start = seeds.select(F.expr(f"member div {BITS}").alias("block"), "id", bit.alias("bits")).groupBy("block", "id").agg(F.bit_or("bits").alias("bits"))
    near = checkpoint(start.withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        frontier = near.where(F.col("hop") == hop - 1).select("block", F.col("id").alias("a"), "bits")
        step = both.join(broadcast_if_few(frontier), "a").groupBy("block", F.col("b").alias("id")).agg(F.bit_or("bits").alias("bits"))
        seen = near.groupBy("block", "id").agg(F.bit_or("bits").alias("seen"))
        fresh = step.join(seen, ["block", "id"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        near = checkpoint(near.unionByName(fresh.where("bits <> 0").select("block", "id", "bits", F.lit(hop).alias("hop"))))
    return near


def members_of(df: DataFrame) -> DataFrame:
    """df(block, bits, ...) with one row for each bit, as ``member`` in place of block and bits."""
    rest = [c for c in df.columns if c not in ("block", "bits")]
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda m: F.getbit(F.col("bits"), m) == 1)).alias("m")
    return df.select("block", each, *rest).select((F.col("block") * BITS + F.col("m")).alias("member"), *rest)


def induced_edges_of(e: DataFrame, near: DataFrame) -> DataFrame:
    """The edges of ``e`` with the members (block, bits) that have both ends in their neighbourhood ``near``."""
    own = checkpoint(near.groupBy("block", "id").agg(F.bit_or("bits").alias("bits")))
    own = broadcast_if_few(own)
    met = e.join(own.withColumnRenamed("id", "src"), "src").join(own.select("block", F.col("id").alias("dst"), F.col("bits").alias("other")), ["block", "dst"])
    return met.withColumn("bits", F.col("bits").bitwiseAND(F.col("other"))).where("bits <> 0").select("block", "bits", *e.columns)
