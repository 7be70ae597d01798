"""Explanations: evidence around an entity, and sentences for analysts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_few, checkpoint, materialize
from ..settings import DEFAULTS
from .graph import induced_edges, induced_edges_of, members_of, neighbourhood, neighbourhoods, node_id


def evidence(vertices: DataFrame, edges: DataFrame, wallets: DataFrame, hops: int = DEFAULTS.evidence_hops) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph induced by all nodes within ``hops`` of the wallets that are in the graph."""
    seeds = wallets.select(node_id("Wallet", F.col("wallet")).alias("id")).join(vertices, "id", "left_semi")
    near = neighbourhood(edges, seeds, hops)
    return vertices.join(near, "id").select(*vertices.columns, "hop"), induced_edges(edges, near)


def evidence_of(vertices: DataFrame, edges: DataFrame, members: DataFrame, hops: int = DEFAULTS.evidence_hops) -> tuple[DataFrame, DataFrame]:
    """members(entity_id, wallet) -> (nodes, edges), each with entity_id: ``evidence`` of every entity, found in one walk of all.

    The entities are those to be explained, so that numbering them is a matter of few rows; their wallets and
    neighbourhoods may be many. An entity whose wallets aren't in the graph has no rows. Edges are read once for each hop and once
    more, vertices once for the wallets and once for the nodes; few rows are met before vertices are grouped.
    """
    entities = members.select("entity_id").distinct()
    numbers = checkpoint(entities.withColumn("member", F.row_number().over(Window.orderBy("entity_id")).cast("long") - 1))
    of_ids = lambda ids: vertices.join(broadcast_if_few(materialize(ids.select("id").distinct())), "id", "left_semi")
    wallets = materialize(members.join(numbers, "entity_id").select("member", node_id("Wallet", F.col("wallet")).alias("id")))
    seeds = wallets.join(of_ids(wallets).select("id"), "id", "left_semi")
    near = neighbourhoods(edges, seeds, hops)
    named = lambda df: members_of(df).join(F.broadcast(numbers), "member").drop("member")
    nodes = named(near).join(of_ids(near), "id").select("entity_id", *vertices.columns, "hop")
    return nodes, named(induced_edges_of(edges, near)).select("entity_id", *edges.columns)


def top_features(values: Column, n: int = 3) -> Column:
    """The ``n`` entries of a map of attributions that are largest in size, ties by name."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct((-F.abs(e["value"])).alias("order"), e["key"].alias("name"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def sentence(top: Column | None = None) -> Column:
    """The explanation of a row with motif_reasons, distinct_ip_count, tx_count and round_trip_time_mean."""
    # The wording.
    spread = F.concat(F.col("distinct_ip_count").cast("string"), F.lit(" distinct broadcast IP(s) across "), F.col("tx_count").cast("string"), F.lit(" transactions"))
    quick = F.when(F.col("round_trip_time_mean") < 3600, F.concat(F.lit(", funds moved onward in ~"), F.format_string("%.1f", F.col("round_trip_time_mean") / 60), F.lit(" minutes on average")))
    known = F.col("motif_reasons").isNotNull() & ~F.col("motif_reasons").isin("", "none")
    kind = F.when(known, F.concat(F.lit(" — consistent with a "), F.replace("motif_reasons", F.lit("_"), F.lit(" ")), F.lit(" typology")))
    empty = F.lit("")
    out = F.concat(F.lit("Flagged: "), spread, F.coalesce(quick, empty), F.coalesce(kind, empty), F.lit("."))
    if top is None:
        return out
    listed = F.array_join(F.transform(top, lambda e: F.concat(e["name"], F.lit(" ("), F.format_string("%+.2f", e["value"]), F.lit(")"))), ", ")
    return F.when(F.coalesce(F.size(top), F.lit(0)) > 0, F.concat(out, F.lit(" Top contributing features: "), listed, F.lit("."))).otherwise(out)
