"""Fusing detector scores into one risk score, ranking, and fitting the weights to feedback."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from ..settings import DEFAULTS


def aligned(scores: Mapping[str, DataFrame], how: str = "full") -> DataFrame:
    """(entity_id, one column per detector). With "full" a missing score is 0, with "inner" the entity goes."""
    out = None
    for name, df in scores.items():
        one = df.select("entity_id", F.col(name))
        out = one if out is None else out.join(one, "entity_id", how)
    return out.fillna(0.0, subset=list(scores)) if how == "full" else out


def risk(columns: list[str], weights: Mapping[str, float]) -> Column:
    """The weighted mean of the columns that have a weight; weights of absent detectors are shared out."""
    used = {c: w for c, w in weights.items() if c in columns}
    total = sum(used.values()) or 1.0
    out = F.lit(0.0)
    for c, w in used.items():
        out = out + F.col(c) * F.lit(w / total)
    return out


def ranked_by(df: DataFrame, column: str, into: str = "rank", rows_a_part: int = 200_000) -> DataFrame:
    """``df`` with ranks 1, 2, ... by a column from high to low, then entity_id, without a window over everything.

    Rows are dealt out by ranges of (column, entity_id), so that tied scores are split like any others; a
    rank is the number of rows in earlier parts plus the place in the own one.
    """
    df = checkpoint(df)
    parts = max(1, math.ceil(df.count() / rows_a_part))
    order = [F.col(column).desc(), F.col("entity_id").asc()]
    # Written, so that the parts stay what they were counted as.
    dealt = checkpoint(df.repartitionByRange(parts, *order).select(F.struct("*").alias("row"))).select("row", F.spark_partition_id().alias("part"))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(f"row.{column}").desc(), F.col("row.entity_id").asc()))
    placed = dealt.withColumn("place", within).join(F.broadcast(starts), "part")  # one row for each part
    return placed.select("row.*", (F.col("before") + F.col("place")).cast("long").alias(into))


def fuse(scores: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, threshold: float = DEFAULTS.alert_threshold) -> DataFrame:
    """(entity_id, scores..., risk_score, rank, is_alert)."""
    wide = aligned(scores)
    out = wide.withColumn("risk_score", risk(list(scores), weights or DEFAULTS.fusion_weights))
    return ranked_by(out, "risk_score").withColumn("is_alert", F.col("risk_score") >= threshold)


def describe(ranked: DataFrame, features: DataFrame, motifs: DataFrame, isolation: DataFrame | None, geo: DataFrame | None) -> DataFrame:
    """``ranked`` with features, motif_reasons, community score and location."""
    out = ranked.join(features, "entity_id", "left").join(motifs.select("entity_id", "motif_reasons"), "entity_id", "left").fillna("none", subset=["motif_reasons"])
    for extra in (isolation, geo):
        if extra is not None:
            out = out.join(extra, "entity_id", "left")
    return out


def fit_weights(scores: Mapping[str, DataFrame], labels: DataFrame) -> tuple[dict[str, float], float, int] | None:
    """Logistic weights of the detectors against labels(entity_id, label): (coefficients, intercept, examples).

    Classes weigh alike and the penalty is half the squared norm against the summed loss. None
    unless entities of both classes have scores.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = checkpoint(aligned(scores, "inner").join(labels.select("entity_id", F.col("label").cast("double")), "entity_id"))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return None
    n = sum(sizes.values())
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1.0, n / (2 * sizes[1.0])).otherwise(n / (2 * sizes[0.0])))
    data = VectorAssembler(inputCols=list(scores), outputCol="x").transform(weighted)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
    return dict(zip(scores, map(float, model.coefficients.toArray()), strict=True)), float(model.intercept), n


def positive_weights(coefficients: Mapping[str, float]) -> dict[str, float]:
    """Negative coefficients become 0; the rest sum to 1, unless all are 0."""
    clipped = {k: max(0.0, v) for k, v in coefficients.items()}
    total = sum(clipped.values())
    return {k: v / total if total else 0.0 for k, v in clipped.items()}
