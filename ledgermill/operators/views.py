"""The questions an analyst's screen asks of the ranking and of evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees, induced_edges

DEFAULT_COLUMNS = ("entity_id", "rank", "risk_score", "is_alert", "motif_reasons", "tx_count", "fan_in", "fan_out", "distinct_ip_count")


def typologies(ranked: DataFrame) -> DataFrame:
    """(typology), distinct and sorted; includes "none"."""
    return ranked.select(F.explode(F.split("motif_reasons", ",")).alias("t")).select(F.trim("t").alias("typology")).distinct().orderBy("typology")


def alerts(ranked: DataFrame, min_score: float = 0.0, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows at ``min_score`` or above, with any of the motifs ``kinds``; ``columns`` selects, ["*"] for all."""
    out = ranked.where(F.col("risk_score") >= min_score)
    if kinds:
        out = out.where(F.coalesce(F.col("motif_reasons").rlike("|".join(re.escape(k) for k in kinds)), F.lit(False)))
    if columns == ["*"]:
        return out
    return out.select(*[c for c in (columns or DEFAULT_COLUMNS) if c in ranked.columns])


def located(ranked: DataFrame) -> DataFrame:
    return ranked.dropna(subset=["latitude", "longitude"])


def entity(ranked: DataFrame, entity_id: str) -> DataFrame:
    return ranked.where(F.col("entity_id") == entity_id)


def wallets_of(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id).select("wallet")


def of_kinds(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the nodes of some kinds."""
    kept = nodes.where(F.col("kind").isin(kinds))
    return kept, induced_edges(edges, kept)


def node_display(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, kind, label, size, is_seed): larger with the degree, and for seeds(id)."""
    deg = degrees(edges)
    top = deg.agg(F.max("degree")).first()[0] or 1
    raw = F.substring("id", F.instr("id", ":") + 1, F.lit(1_000_000))
    rows = nodes.join(deg, "id", "left").join(seeds.select("id", F.lit(True).alias("_seed")).distinct(), "id", "left")
    is_seed = F.coalesce("_seed", F.lit(False))
    size = 14 + 10 * (F.coalesce("degree", F.lit(0)) / F.lit(top)) + F.when(is_seed, 8).otherwise(0)
    label = F.concat(F.substring(raw, 1, 8), F.when(F.length(raw) > 8, "…").otherwise(""))
    return rows.select("id", "kind", label.alias("label"), size.cast("double").alias("size"), is_seed.alias("is_seed"))


def node_details(nodes: DataFrame) -> DataFrame:
    """(kind, raw_id, amount_btc, timestamp, asn), each where its kind has it."""
    raw = F.substring("id", F.instr("id", ":") + 1, F.lit(1_000_000))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return nodes.select("kind", raw.alias("raw_id"), of("Transaction", "amount_btc").alias("amount_btc"), of("Transaction", "timestamp").alias("timestamp"), F.when(F.col("kind") == "ASN", F.coalesce("asn", raw)).alias("asn"))


def property_nodes(nodes: DataFrame, column: str, values: list) -> DataFrame:
    """Nodes whose property is one of the values."""
    return nodes.where(F.col(column).isin(values)).select("id")


def property_endpoints(edges: DataFrame, column: str, values: list) -> DataFrame:
    """Both ends of the edges whose property is one of the values."""
    return edges.where(F.col(column).isin(values)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
