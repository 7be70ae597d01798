"""Geographic enrichment of IP addresses by range join.

Each distinct public address is looked up once. Blocks are spread over the buckets of
their leading 16 bits, which turns the range join into an equi-join with a residual; the
longest prefix wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import ip_key, ip_to_long, is_public, is_public_key, masked

GEO_FIELDS = {"country": "string", "city": "string", "latitude": "double", "longitude": "double", "asn_org": "string"}
BUCKET = 1 << 16
#: Networks that are broadcast at most, and the shares into which the addresses of a short prefix are dealt where there are more.
FEW, SHARES = 100_000, 64


def lookup(ips: DataFrame, blocks: DataFrame) -> DataFrame:
    """ips(ip) distinct, blocks(ip_start, ip_end, prefix, GEO_FIELDS) -> (ip, GEO_FIELDS) of the addresses found."""
    numbered = ips.withColumn("_n", ip_to_long(F.col("ip"))).where(is_public(F.col("_n"))).withColumn("_b", F.floor(F.col("_n") / BUCKET).cast("long"))
    spread = blocks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("ip_start") / BUCKET).cast("long"), F.floor(F.col("ip_end") / BUCKET).cast("long"))))
    met = numbered.join(spread, "_b").where("_n between ip_start and ip_end")
    best = F.max_by(F.struct(*GEO_FIELDS), F.struct("prefix", "ip_start")).alias("g")
    return met.groupBy("ip").agg(best).select("ip", "g.*")


def lookup_prefixes(ips: DataFrame, blocks: DataFrame) -> DataFrame:
    """ips(ip) distinct, of either version, blocks(network, GEO_FIELDS) -> (ip, GEO_FIELDS) of the addresses found.

    The longest prefix wins. An address is cut to each prefix length that a block of its version has, 33 and 129 at
    most, and met by equal keys, so that no block is spread and no range compared. Of equal networks the largest fields win.
    """
    first = ip_key(F.substring_index("network", "/", 1))
    nets = blocks.select(first.alias("k"), F.substring_index("network", "/", -1).try_cast("int").alias("prefix"), *GEO_FIELDS).where("k is not null and prefix is not null")
    hi, lo = masked(F.col("k.version"), F.col("k.hi"), F.col("k.lo"), F.col("prefix"))
    nets = nets.select(F.col("k.version").alias("version"), hi.alias("hi"), lo.alias("lo"), "prefix", *GEO_FIELDS)
    lengths = nets.groupBy("version").agg(F.collect_set("prefix").alias("lengths"))
    keyed = ips.withColumn("k", ip_key(F.col("ip"))).where(is_public_key(F.col("k"))).select("ip", "k.*")
    cut = keyed.join(F.broadcast(lengths), "version").withColumn("prefix", F.explode("lengths"))  # two rows
    cut_hi, cut_lo = masked(F.col("version"), F.col("hi"), F.col("lo"), F.col("prefix"))
    # A short prefix may hold most addresses. Few networks are broadcast; the short ones of many are repeated, for as many shares of their addresses.
    if nets.limit(FEW + 1).count() <= FEW:
        nets, share = F.broadcast(nets.withColumn("share", F.lit(0))), F.lit(0)
    else:
        short = F.col("prefix") <= F.when(F.col("version") == 4, 16).otherwise(40)
        nets = nets.withColumn("share", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))))
        share = F.when(short, F.pmod(F.xxhash64("ip"), F.lit(SHARES)).cast("int")).otherwise(0)
    met = cut.select("ip", "version", "prefix", cut_hi.alias("hi"), cut_lo.alias("lo"), share.alias("share")).join(nets, ["version", "prefix", "hi", "lo", "share"])
    best = F.max_by(F.struct(*GEO_FIELDS), F.struct("prefix", F.struct(*GEO_FIELDS))).alias("g")
    return met.groupBy("ip").agg(best).select("ip", "g.*")


def enrich(rows: DataFrame, blocks: DataFrame | None, ip_col: str = "broadcast_ip") -> DataFrame:
    """``rows`` with the five GEO_FIELDS; all null without blocks.

    ``blocks`` are IPv4 ranges, or networks of either version if they have a column ``network``.
    """
    if blocks is None:
        return rows.withColumns({f: F.lit(None).cast(t) for f, t in GEO_FIELDS.items()})
    find = lookup_prefixes if "network" in blocks.columns else lookup
    found = find(rows.select(F.col(ip_col).alias("ip")).distinct(), blocks).withColumnRenamed("ip", "_ip")
    return rows.join(found, F.col(ip_col) == F.col("_ip"), "left").drop("_ip")


def enrich_from(rows: DataFrame, city: DataFrame | None, network: DataFrame | None, ip_col: str = "broadcast_ip") -> DataFrame:
    """``rows`` with the place of one database and the organisation of another; either may be absent."""
    placed = enrich(rows, city, ip_col).drop("asn_org")
    owned = enrich(placed.select(F.struct("*").alias("_row"), F.col(ip_col).alias("_ip_of")), network, "_ip_of")
    return owned.select("_row.*", "asn_org")
