"""Which wallets belong together: linkage rules, and entities as connected components.

Every rule gives star edges to one wallet of a group, never all pairs, so that a very
busy address costs one edge per wallet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import micros_between, time_slice
from ..session import materialize
from ..settings import DEFAULTS
from .components import connected_components


def co_input_edges(tx: DataFrame) -> DataFrame:
    """(a, b): the senders of one transaction. A grouped minimum, joined back, rather than a window over a hot key.

    What is joined back are only the transactions with two senders, as a table whose size is known.
    """
    lowest = tx.groupBy("tx_id").agg(F.min("src_wallet").alias("b"), F.max("src_wallet").alias("_high"))
    lowest = materialize(lowest.where("b <> _high").select("tx_id", "b"))
    return tx.select("tx_id", F.col("src_wallet").alias("a")).join(lowest, "tx_id").where("a <> b").select("a", "b").distinct()


def repeated_hashes(tx: DataFrame) -> DataFrame:
    """(h): hashes of the ids of transactions with several rows, as a table whose size is known; two ids that share a hash are among them."""
    return materialize(tx.groupBy(F.xxhash64("tx_id").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"))


def repeated_transactions(tx: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """The rows whose transaction has several, by hashes of ids (``repeated_hashes``); two ids that share a hash can only add rows."""
    return tx.join(repeated_hashes(tx) if several is None else several, F.xxhash64("tx_id") == F.col("h"), "left_semi")


def co_input_merges(tx: DataFrame) -> DataFrame:
    """(tx_id, merges): rows beyond the first of each transaction."""
    return tx.groupBy("tx_id").agg((F.count("*") - 1).alias("merges")).where("merges > 0")


def _two_sided_cells(tx: DataFrame, width: int) -> DataFrame:
    """(cell): hashes of the wallets and slices of ``width`` with transfers both in and out, as a table whose size is known.

    Two cells that share a hash can only add some, which hold no pass-through.
    """
    own = time_slice(F.col("timestamp"), width)
    came = tx.select(F.xxhash64("dst_wallet", own).alias("cell"))
    left = tx.select(F.explode(F.array(F.xxhash64("src_wallet", own), F.xxhash64("src_wallet", own - 1))).alias("cell"))
    # Hashed, not sorted or summed: nearly all cells are there once, and a cell that is met often is held once.
    return materialize(left.join(came.hint("shuffle_hash"), "cell", "left_semi").distinct())


def pass_through(tx: DataFrame, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention) -> DataFrame:
    """(wallet, in_tx, out_tx, sender, recipient, gap_us): incoming funds that leave again at once.

    A forward as-of join as one window: the earliest outgoing transfer at or after an
    incoming one, of which the gap and then the retained share are tested. Equal times
    go by transaction id, and outgoing events follow incoming ones.

    Time is cut into slices of ``gap_s``. An outgoing transfer counts in its own slice and the one before,
    which holds every incoming one that it can follow in time; so no task orders all that one wallet does.
    Only what shares a wallet and a slice with the other side is ordered.
    """
    width = max(1, math.ceil(gap_s))
    met_cells = _two_sided_cells(tx, width)
    event = F.array(
        F.struct(F.col("dst_wallet").alias("wallet"), F.lit(0).alias("is_out"), F.col("src_wallet").alias("other")),
        F.struct(F.col("src_wallet").alias("wallet"), F.lit(1).alias("is_out"), F.col("dst_wallet").alias("other")),
    )
    events = tx.select("tx_id", F.col("timestamp").alias("ts"), F.col("amount_btc").alias("amount"), F.explode(event).alias("e")).select("tx_id", "ts", "amount", "e.*")
    own = time_slice(F.col("ts"), width)
    events = events.withColumn("slice", F.explode(F.when(F.col("is_out") == 1, F.array(own, own - 1)).otherwise(F.array(own))))
    events = events.join(met_cells, F.xxhash64("wallet", "slice") == F.col("cell"), "left_semi")
    # From the latest event back: frames that only grow cost one step a row.
    back = Window.partitionBy("wallet", "slice").orderBy(F.col("ts").desc(), F.col("is_out").desc(), F.col("tx_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = F.last(F.when(F.col("is_out") == 1, F.struct("tx_id", "ts", "amount", "other")), ignorenulls=True).over(back)
    met = events.withColumn("o", out).where("is_out = 0 and o is not null").withColumn("gap_us", micros_between(F.col("ts"), F.col("o.ts")))
    kept = met.where((F.col("gap_us") <= gap_s * 1_000_000) & (F.col("amount") > 0))
    kept = kept.where(F.col("o.amount") / F.when(F.col("amount") > 0, F.col("amount")) >= retention)
    return kept.select("wallet", F.col("tx_id").alias("in_tx"), F.col("o.tx_id").alias("out_tx"), F.col("other").alias("sender"), F.col("o.other").alias("recipient"), "gap_us")


def pass_through_edges(tx: DataFrame, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention) -> DataFrame:
    found = pass_through(tx, gap_s, retention)
    return found.select("wallet", F.explode(F.array("sender", "recipient")).alias("b")).select(F.col("wallet").alias("a"), "b").distinct()


def co_broadcast_edges(tx: DataFrame) -> DataFrame:
    """(a, b): senders behind one address, at any time."""
    # Addresses are sorted by hash first, since most begin alike.
    by = ["_h", "broadcast_ip"]
    pairs = tx.select(F.xxhash64("broadcast_ip").alias("_h"), "broadcast_ip", F.col("src_wallet").alias("a")).distinct()
    lowest = pairs.groupBy(*by).agg(F.min("a").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    return pairs.join(lowest, by).where("a <> b").select("a", "b").distinct()


def link_edges(tx: DataFrame, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention, several: DataFrame | None = None) -> DataFrame:
    """(a, b, rule) of all rules; ``several`` are the ``repeated_hashes`` if they are known."""
    return (
        co_input_edges(repeated_transactions(tx, several)).withColumn("rule", F.lit("co_input"))
        .unionByName(pass_through_edges(tx, gap_s, retention).withColumn("rule", F.lit("pass_through")))
        .unionByName(co_broadcast_edges(tx).withColumn("rule", F.lit("co_broadcast")))
    )


@dataclass
class Linked:
    """Transfers with their ``linked_wallets``, so that these are found once."""

    rows: DataFrame
    wallets: DataFrame


def linked_wallets(tx: DataFrame, *, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention, several: DataFrame | None = None) -> DataFrame:
    """(id, component) of the wallets that a rule links to another one."""
    return connected_components(link_edges(tx, gap_s, retention, several).select("a", "b"))


def entity_name(root: Column, full_ids: bool = False) -> Column:
    """The name of the entity whose smallest wallet is ``root``: its first ten characters, or all of it with ``full_ids``."""
    return F.concat(F.lit("entity_"), root if full_ids else F.substring(root, 1, DEFAULTS.entity_id_chars))


def wallet_entities(tx: DataFrame | Linked, *, gap_s: int = DEFAULTS.pass_through_gap_s, retention: float = DEFAULTS.retention, full_ids: bool = False) -> DataFrame:
    """(wallet, entity_id) for every wallet that sends or receives.

    An entity is named after its smallest wallet. By default the name keeps the first ten characters
    of it, so that entities that agree in those merge; ``full_ids`` keeps all.
    """
    found = tx if isinstance(tx, Linked) else Linked(tx, linked_wallets(tx, gap_s=gap_s, retention=retention))
    wallets = found.rows.select(F.explode(F.array("src_wallet", "dst_wallet")).alias("wallet")).distinct()
    parts = found.wallets
    return wallets.join(parts, wallets.wallet == parts.id, "left").select("wallet", entity_name(F.coalesce("component", "wallet"), full_ids).alias("entity_id"))
