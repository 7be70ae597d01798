"""Streaming counterparts of the batch rules, for live feeds.

Validation is stateless and applies as it is. Send bursts are windowed counts under a watermark.
Pass-through links are a stream-stream join within the gap, of which each micro-batch keeps the
earliest outgoing transfer per incoming one. Entities, models and global ranks remain batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import validate
from ..settings import DEFAULTS
from ..sources.readers import RAW


def read_feed(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """CSV files that arrive in a folder, all columns as strings."""
    return spark.readStream.schema(RAW).option("header", True).option("maxFilesPerTrigger", max_files).csv(path)


def clean_feed(raw: DataFrame, delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(clean, rejected); clean rows carry event_time with a watermark."""
    clean, rejected = validate(raw)
    return clean.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay), rejected


def send_bursts(clean: DataFrame, window: str = "30 minutes", slide: str = "5 minutes", least: int = DEFAULTS.peel_min_hops) -> DataFrame:
    """(window, src_wallet, sends, ips): wallets that send often within a sliding window."""
    counts = clean.groupBy(F.window("event_time", window, slide), "src_wallet").agg(F.count("*").alias("sends"), F.approx_count_distinct("broadcast_ip").alias("ips"))
    return counts.where(F.col("sends") >= least)


def pass_through_candidates(clean: DataFrame, gap_s: int = DEFAULTS.pass_through_gap_s) -> DataFrame:
    """Pairs of an incoming and an outgoing transfer of one wallet within the gap."""
    incoming = clean.select(F.col("dst_wallet").alias("wallet"), F.col("tx_id").alias("in_tx"), F.col("src_wallet").alias("sender"), F.col("amount_btc").alias("in_amount"), F.col("event_time").alias("in_time"))
    outgoing = clean.select(F.col("src_wallet").alias("wallet2"), F.col("tx_id").alias("out_tx"), F.col("dst_wallet").alias("recipient"), F.col("amount_btc").alias("out_amount"), F.col("event_time").alias("out_time"))
    return incoming.join(outgoing, F.expr(f"wallet = wallet2 AND out_time >= in_time AND out_time <= in_time + INTERVAL {gap_s} SECONDS")).drop("wallet2")


def earliest(candidates: DataFrame, retention: float = DEFAULTS.retention) -> DataFrame:
    """For a batch of candidates: the nearest outgoing transfer of each incoming one, if it keeps enough."""
    nearest = candidates.groupBy("wallet", "in_tx").agg(F.min_by(F.struct("sender", "recipient", "out_tx", "in_amount", "out_amount"), F.struct("out_time", "out_tx")).alias("m")).select("wallet", "in_tx", "m.*")
    return nearest.where((F.col("in_amount") > 0) & (F.col("out_amount") >= retention * F.col("in_amount")))
