"""Where results go. All paths may lie in any store that Spark writes to."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import iso_text
from .readers import BATCH_CSV, FEEDBACK


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, nested columns and variants as JSON, for CSV."""
    out = df
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind.startswith("timestamp"):
            out = out.withColumn(f.name, iso_text(F.col(f.name)))
        elif kind in ("array", "map", "struct", "variant"):
            out = out.withColumn(f.name, F.to_json(f.name))
    return out


def write_rejects(rejected: DataFrame, path: str) -> None:
    _plain(rejected).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ranked(ranked: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Parquet and CSV under ``path``, by rank. Files are ranges of ranks; ``one_file`` merges the CSV."""
    ordered = ranked.orderBy("rank")
    ordered.write.mode("overwrite").parquet(f"{path}/ranked.parquet")
    text = _plain(ordered.coalesce(1) if one_file else ordered)
    text.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/ranked.csv")


def append_feedback(rows: DataFrame, path: str) -> None:
    """Add rows to the log, as a batch in a folder of its own, so that writers never meet.

    A batch counts once its job has ended, which Spark's _SUCCESS file marks. Its rows get the time of
    the append in microseconds as ``seq``, unless they carry one.
    """
    number = time.time_ns() // 1000
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FEEDBACK]
    seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(number).cast("long").alias("seq")
    rows.select(*columns, seq).write.options(**BATCH_CSV).csv(f"{path}/batch={number}-{uuid.uuid4().hex}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_weights(spark: SparkSession, path: str, weights: dict[str, float], bias: float, n: int) -> None:
    write_text(spark, json.dumps({"weights": weights, "bias": bias, "n_feedback_examples": n}, indent=2), path)


def write_report(spark: SparkSession, doc: dict, text: str, folder: str) -> None:
    write_text(spark, json.dumps(doc, indent=2), f"{folder}/evaluation_report.json")
    write_text(spark, text, f"{folder}/evaluation_report.md")


def write_transactions(tx: DataFrame, truth: DataFrame, folder: str) -> None:
    tx.write.mode("overwrite").parquet(f"{folder}/transactions.parquet")
    _plain(tx).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/transactions.csv")
    truth.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/ground_truth.csv")


def summary(ranked: DataFrame, n: int = 10) -> str:
    """The best ranked entities as text."""
    rows = ranked.orderBy("rank").limit(n).select("rank", "entity_id", "risk_score", "motif_reasons").collect()
    return "\n".join(f"{r['rank']:>4}  {r.entity_id:<20} {r.risk_score:.3f}  {r.motif_reasons}" for r in rows)
