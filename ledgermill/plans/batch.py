"""The whole batch run: ingest, resolve, score, rank, write; and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import autoencoder, communities, enrich, evaluate, feedback, forest, fusion, graph, linkage, motifs, validate
from ..operators.features import entity_features, entity_geo, touches, with_entities
from ..session import checkpoint, materialize
from ..sources import readers, sinks

Detector = Callable[[DataFrame], DataFrame]

#: Detectors over entity features: name -> f(features) -> (entity_id, name). One that is left out gives its weight to the others.
DETECTORS: dict[str, Detector] = {"isolation_forest_score": forest.scores, "autoencoder_score": autoencoder.scores}


@dataclass
class Run:
    clean: DataFrame
    rejected: DataFrame
    entities: DataFrame
    vertices: DataFrame
    edges: DataFrame
    scores: dict[str, DataFrame]
    ranked: DataFrame


def ingest(spark: SparkSession, paths: list[str], cidr: str | None = None, with_geo: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) of files in any format; clean rows with location columns unless ``with_geo`` is off."""
    clean, rejected = validate.validate(readers.read_many(spark, paths))
    return (enrich.enrich(clean, readers.read_cidr(spark, cidr)) if with_geo else clean), rejected


def analyse(clean: DataFrame, rejected: DataFrame, *, weights: Mapping[str, float] | None = None, detectors: Mapping[str, Detector] = DETECTORS) -> Run:
    """Resolve entities in ``clean``, score them with all detectors, and rank them."""
    clean = materialize(clean)
    vertices, edges = graph.vertices(clean), graph.edges(clean)
    entities = materialize(linkage.wallet_entities(clean))
    rows = materialize(with_entities(clean, entities))
    features = checkpoint(entity_features(touches(rows)))
    place = entity_geo(rows)
    found = checkpoint(motifs.motif_scores(rows))
    scores = {name: checkpoint(f(features)) for name, f in detectors.items()}
    scores["motif_score"] = found.select("entity_id", "motif_score")
    isolation = communities.entity_isolation(entities, communities.louvain(graph.simple_projection(edges)))
    ranked = fusion.describe(fusion.fuse(scores, weights), features, found, isolation, place)
    return Run(clean, rejected, entities, vertices, edges, scores, materialize(ranked))


def run(spark: SparkSession, paths: list[str], out: str, cidr: str | None = None) -> Run:
    """Everything, with its outputs under ``out``. Weights re-fitted from feedback serve the next run."""
    clean, rejected = ingest(spark, paths, cidr)
    learned = readers.read_weights(spark, f"{out}/learned_fusion_weights.json")
    done = analyse(clean, rejected, weights=learned)
    sinks.write_rejects(done.rejected, f"{out}/rejected_records.csv")
    sinks.write_ranked(done.ranked, out)
    for name in ("vertices", "edges", "entities"):
        getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    feedback.retrain(done.scores, readers.read_feedback(spark, f"{out}/feedback.csv"), f"{out}/learned_fusion_weights.json")
    return done


def evaluate_run(spark: SparkSession, out: str, truth_path: str) -> dict:
    """Hold a run's ranking against ground truth and write the report."""
    ranked = spark.read.parquet(f"{out}/ranked.parquet")
    entities = spark.read.parquet(f"{out}/entities.parquet")
    truth = spark.read.option("header", True).csv(truth_path).selectExpr("entity_id", "wallets", "cast(is_illicit as boolean) as is_illicit", "typology")
    doc = evaluate.report(ranked, evaluate.cluster_truth(entities, truth), learned=readers.path_exists(spark, f"{out}/learned_fusion_weights.json"))
    sinks.write_report(spark, doc, evaluate.markdown(doc), out)
    return doc
