"""Analyst feedback, and re-fitting the fusion weights from it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from ..sources import readers
from ..sources.readers import FEEDBACK
from ..sources.sinks import append_feedback, write_text, write_weights
from .fusion import fit_weights, positive_weights


def record(spark: SparkSession, path: str, entity_id: str, is_illicit: bool, note: str = "") -> None:
    """Append one label to the log, with the time in UTC seconds."""
    stamp = datetime.now(UTC).isoformat(timespec="seconds")
    append_feedback(spark.createDataFrame([(entity_id, int(is_illicit), note, stamp)], FEEDBACK), path)


def latest(log: DataFrame, keep_seq: bool = False) -> DataFrame:
    """The last row per entity by timestamp, then by seq if the log has one, then by label."""
    order = F.struct("timestamp", *(["seq"] if "seq" in log.columns else []), "label")
    keep = [c for c in log.columns if c != "entity_id" and (keep_seq or c != "seq")]
    return log.groupBy("entity_id").agg(F.max_by(F.struct(*keep), order).alias("r")).select("entity_id", "r.*")


def compact(spark: SparkSession, path: str) -> None:
    """Take up all batches of the log in one, with the last label of each entity.

    The new batch lists those that it replaces, and only those: what is appended meanwhile stays apart and counts.
    Until the list is written, old and new rows are both there, which agree, so that a run that is lost in between does no harm,
    nor do two at once. Replaced batches stay for those who read them now; the next compaction deletes them.
    """
    if not readers.path_exists(spark, path):
        return
    live, replaced = readers.feedback_batches(spark, path)
    if len(live) < 2:
        return
    name = f"batch={time.time_ns() // 1000}-{uuid.uuid4().hex}"
    rows = latest(readers.read_feedback(spark, path, live), keep_seq=True)
    rows.select(*[f.name for f in FEEDBACK], "seq").write.options(**readers.BATCH_CSV).csv(f"{path}/{name}")
    write_text(spark, "\n".join([*live, *replaced]), f"{path}/{name}/{readers.REPLACES}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in replaced:
        store.delete(hadoop.Path(f"{path}/{old}"), True)


def ready(labels: DataFrame, least: int = DEFAULTS.min_feedback) -> DataFrame:
    """One row: n_labels, n_classes and enough, whether there are ``least`` labels of both classes."""
    sums = labels.agg(F.count("label").alias("n_labels"), F.count_distinct("label").alias("n_classes"))
    return sums.withColumn("enough", (F.col("n_labels") >= least) & (F.col("n_classes") >= 2))


def retrain(scores: Mapping[str, DataFrame], log: DataFrame, path: str | None = None, least: int = DEFAULTS.min_feedback) -> dict[str, float] | None:
    """New fusion weights, written to ``path``; None if there is too little feedback, or of one class only, on scored entities."""
    labels = latest(log)
    if not ready(labels, least).first().enough:
        return None
    fitted = fit_weights(scores, labels)
    if fitted is None:
        return None
    weights = positive_weights(fitted[0])
    if path:
        write_weights(log.sparkSession, path, weights, fitted[1], fitted[2])
    return weights
