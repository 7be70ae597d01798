"""Evaluation of a ranking against ground truth."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS

TOP_K = (10, 25, 50, 100)


def cluster_truth(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity_id, is_illicit, typology) of entities: illicit if any wallet is, with the typology of its largest illicit wallet."""
    wallets = truth.select(F.explode(F.split("wallets", ";")).alias("wallet"), "is_illicit", "typology", "entity_id")
    labels = wallets.groupBy("wallet").agg(F.max_by(F.struct("is_illicit", "typology"), "entity_id").alias("t")).select("wallet", "t.*")
    rows = entities.join(labels, "wallet", "left").withColumn("is_illicit", F.coalesce("is_illicit", F.lit(False)))
    kind = F.max_by(F.when(F.col("is_illicit"), F.col("typology")), F.when(F.col("is_illicit"), F.col("wallet")))
    return rows.groupBy("entity_id").agg(F.bool_or("is_illicit").alias("is_illicit"), F.coalesce(kind, F.lit("none")).alias("typology"))


def judged(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return ranked.select("entity_id", "rank", "is_alert").join(truth, "entity_id", "left").withColumn("is_illicit", F.coalesce("is_illicit", F.lit(False)))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, n_scored, n_illicit, n_flagged, precision, recall, f1."""
    yes, flagged = F.col("is_illicit"), F.col("is_alert")
    sums = rows.agg(F.count_if(yes & flagged).alias("tp"), F.count_if(~yes & flagged).alias("fp"), F.count_if(yes & ~flagged).alias("fn"), F.count("*").alias("n_scored"), F.count_if(yes).alias("n_illicit"), F.count_if(flagged).alias("n_flagged"))
    sums = sums.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_at(rows: DataFrame, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """(k, precision_at_k); with fewer than k entities their number divides."""
    each = rows.where(F.col("rank") <= max(ks)).select("rank", "is_illicit", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return each.where("rank <= k").groupBy("k").agg(F.avg(F.col("is_illicit").cast("double")).alias("precision_at_k"))


def recall_by_typology(rows: DataFrame) -> DataFrame:
    return rows.where("is_illicit").groupBy("typology").agg(F.avg(F.col("is_alert").cast("double")).alias("recall"))


def report(ranked: DataFrame, truth: DataFrame, *, learned: bool = False, threshold: float = DEFAULTS.alert_threshold, ks: tuple[int, ...] = TOP_K) -> dict:
    """All figures as one document."""
    rows = judged(ranked, truth)
    c = confusion(rows).first()
    at = {r.k: r.precision_at_k for r in precision_at(rows, ks).collect()}
    kinds = {r.typology: r.recall for r in recall_by_typology(rows).collect()}
    # The keys of the report.
    return {
        "generated_at": datetime.now(UTC).isoformat(timespec="seconds"),
        "risk_alert_threshold": threshold,
        "n_entities_scored": c.n_scored,
        "n_entities_true_illicit": c.n_illicit,
        "n_entities_flagged": c.n_flagged,
        "true_positives": c.tp,
        "false_positives": c.fp,
        "false_negatives": c.fn,
        "precision": round(c.precision, 4),
        "recall": round(c.recall, 4),
        "f1": round(c.f1, 4),
        "precision_at_k": {str(k): round(at.get(k, 0.0), 4) for k in ks},
        "recall_by_typology": {k: round(v, 4) for k, v in sorted(kinds.items())},
        "fusion_weights_used": "learned_from_feedback" if learned else "default_config_weights",
    }


def markdown(doc: dict) -> str:
    """The report as text with three tables."""
    table = lambda head, rows: [f"| {head[0]} | {head[1]} |", "|---|---|", *[f"| {a} | {b} |" for a, b in rows]]
    figure = lambda x: f"{x:.3f}"
    overall = [("Precision", figure(doc["precision"])), ("Recall", figure(doc["recall"])), ("F1", figure(doc["f1"])), ("True positives", doc["true_positives"]), ("False positives", doc["false_positives"]), ("False negatives", doc["false_negatives"])]
    lines = ["# Evaluation report", "", f"Generated: {doc['generated_at']}", f"Alert threshold: {doc['risk_alert_threshold']}", f"Fusion weights used: {doc['fusion_weights_used']}"]
    lines += ["", "## Overall", "", *table(("Metric", "Value"), overall)]
    lines += ["", "## Precision at top-K", "", *table(("K", "Precision@K"), [(k, figure(v)) for k, v in doc["precision_at_k"].items()])]
    lines += ["", "## Recall by typology", "", *table(("Typology", "Recall"), [(k, figure(v)) for k, v in doc["recall_by_typology"].items()])]
    return "\n".join(lines) + "\n"
