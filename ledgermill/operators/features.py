"""Features of entities from the transfers that touch them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import gaps, seconds_between
from ..settings import FEATURES
from .linkage import entity_name


def with_entities(tx: DataFrame, entities: DataFrame) -> DataFrame:
    """``tx`` with src_entity and dst_entity, null where a wallet has none."""
    src = entities.select(F.col("wallet").alias("_s"), F.col("entity_id").alias("src_entity"))
    dst = entities.select(F.col("wallet").alias("_d"), F.col("entity_id").alias("dst_entity"))
    return tx.join(src, tx.src_wallet == F.col("_s"), "left").join(dst, tx.dst_wallet == F.col("_d"), "left").drop("_s", "_d")


def with_linked(tx: DataFrame, linked: DataFrame) -> DataFrame:
    """Like ``with_entities``, from ``linkage.linked_wallets``: a wallet without a link is an entity of its own and is not looked up."""
    named = linked.select("id", entity_name(F.col("component")).alias("name"))
    src, dst = named.toDF("_s", "_src"), named.toDF("_d", "_dst")
    both = tx.join(src, tx.src_wallet == F.col("_s"), "left").join(dst, tx.dst_wallet == F.col("_d"), "left")
    own = lambda found, wallet: F.coalesce(F.col(found), entity_name(F.col(wallet)))
    return both.select(*tx.columns, own("_src", "src_wallet").alias("src_entity"), own("_dst", "dst_wallet").alias("dst_entity"))


def with_repeated(tx: DataFrame, several: DataFrame) -> DataFrame:
    """``tx`` with ``repeated``: whether its transaction may have other rows, from ``linkage.repeated_hashes``."""
    met = tx.join(several.select(F.col("h").alias("_h")), F.xxhash64("tx_id") == F.col("_h"), "left")
    return met.select(*tx.columns, (F.col("_h").isNotNull() | F.col("tx_id").isNull()).alias("repeated"))


def touches(labelled: DataFrame, *extra: str) -> DataFrame:
    """Two rows per transfer, one for each side; a transfer within an entity gives it both.

    With the column ``repeated`` there are two more: it, and ``once``, by which a transaction that has no other row is counted at
    one of its touches of each entity.
    """
    known = "repeated" in labelled.columns
    side = lambda name, role, once: F.struct(F.col(name).alias("entity_id"), F.lit(role).alias("role"), *([once.alias("once")] if known else []))
    single, across = ~F.col("repeated"), ~F.col("src_entity").eqNullSafe(F.col("dst_entity"))
    sides = F.array(side("src_entity", "sender", single), side("dst_entity", "receiver", single & across))
    keep = ["tx_id", "timestamp", "amount_btc", "broadcast_ip", "asn", *extra, *(["repeated"] if known else [])]
    return labelled.select(*keep, F.explode(sides).alias("t")).select("t.*", *keep).where("entity_id is not null")


def _or_zero(c: Column) -> Column:
    """0 for null, not-a-number and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def entity_features(touched: DataFrame) -> DataFrame:
    """(entity_id, FEATURES). Every aggregate has partial sums, and gaps are taken slice by slice, so that one huge entity is not one task.

    Where touches tell which transactions have other rows, only those are compared for ``tx_count``.
    """
    waits = gaps(touched, "entity_id").groupBy("entity_id").agg(F.avg(F.col("gap_us") / 1e6).alias("gap_mean"), F.stddev_samp(F.col("gap_us") / 1e6).alias("gap_std"))
    known = "repeated" in touched.columns
    sums = touched.groupBy("entity_id").agg(
        (F.count_if("once") if known else F.count_distinct("tx_id")).alias("tx_count"),
        F.count_if(F.col("role") == "receiver").alias("fan_in"),
        F.count_if(F.col("role") == "sender").alias("fan_out"),
        F.avg("amount_btc").alias("amount_mean"),
        F.coalesce(F.stddev_samp("amount_btc"), F.lit(0.0)).alias("amount_std"),
        F.count_distinct("broadcast_ip").alias("distinct_ip_count"),
        F.count_distinct("asn").alias("distinct_asn_count"),
        seconds_between(F.min("timestamp"), F.max("timestamp")).alias("_span"),
    )
    if known:
        several = touched.where("repeated").groupBy("entity_id").agg(F.count_distinct("tx_id").alias("_several"))
        sums = sums.join(several, "entity_id", "left").withColumn("tx_count", F.col("tx_count") + F.coalesce("_several", F.lit(0)))
    spread = (F.col("distinct_ip_count") - 1) / F.greatest(F.col("tx_count") - 1, F.lit(1))
    out = sums.join(waits, "entity_id", "left").withColumns({
        "inter_tx_time_mean": F.coalesce("gap_mean", F.lit(0.0)),
        "inter_tx_time_std": F.coalesce("gap_std", F.lit(0.0)),
        "amount_cv": F.when(F.col("amount_mean") > 0, F.col("amount_std") / F.when(F.col("amount_mean") > 0, F.col("amount_mean"))).otherwise(0.0),
        "network_obfuscation_score": F.greatest(F.least(spread, F.lit(1.0)), F.lit(0.0)),
        "round_trip_time_mean": F.col("_span") / F.greatest("tx_count", F.lit(1)),
    })
    whole = {"tx_count", "fan_in", "fan_out", "distinct_ip_count", "distinct_asn_count"}
    return out.select("entity_id", *[F.col(f) if f in whole else _or_zero(F.col(f)).alias(f) for f in FEATURES])


GEO_COLUMNS = ("country", "city", "latitude", "longitude")


def entity_geo(labelled: DataFrame) -> DataFrame:
    """(entity_id, country, city, latitude, longitude, distinct_country_count): each entity's commonest place.

    Ties go to the first country and city in order, nulls last; latitude and longitude are
    separate modes within that place, the smallest on ties. Without location columns the result is empty.
    """
    if not set(GEO_COLUMNS) <= set(labelled.columns):
        return labelled.sparkSession.createDataFrame([], "entity_id string, country string, city string, latitude double, longitude double, distinct_country_count long")
    t = touches(labelled, *GEO_COLUMNS)
    countries = t.groupBy("entity_id").agg(F.count_distinct("country").alias("distinct_country_count"))
    places = t.where("latitude is not null and longitude is not null").groupBy("entity_id", "country", "city").agg(
        F.count("*").alias("n"), F.mode("latitude", True).alias("latitude"), F.mode("longitude", True).alias("longitude"))
    order = Window.partitionBy("entity_id").orderBy(F.col("n").desc(), F.col("country").asc_nulls_last(), F.col("city").asc_nulls_last())
    top = places.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("entity_id", *GEO_COLUMNS)
    return countries.join(top, "entity_id", "left").select("entity_id", *GEO_COLUMNS, "distinct_country_count")
