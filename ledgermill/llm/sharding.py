"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within each source. A row's fractional rank
is its place in that order, less a random phase of its source between 0 and 1, over the size of
its source. Sorted by fractional rank, every stretch of rows mixes the sources as the whole does,
so that equal cuts give shards that all match the mixture, with row counts at most one apart.
The phase spreads sources of few rows, which would otherwise all fall on the same ranks.

Neither of the two rankings runs in one task. Each deals rows into many cells by a
uniform key (the shuffle digest, then the fractional rank), counts the cells, and
adds the running total of earlier cells to the rank within the cell. A source with a
third of all rows spreads over proportionally many cells.

The law is that of rows: counts of shards differ by one at most. Equal texts may part, since a
group of copies may be larger than a shard.

Rows that agree in every column are counted first and told apart by an ordinal, so that each row has a key of its
own and reruns agree, whatever ids repeat.

Defined cases: a null source is a source of its own, last of all in ties; a null text
counts as empty; texts of any length stay whole; repeated rows and repeated or null ids are separate rows;
an empty table gives an empty result; ``stratified_shards`` passes other columns by, and ``write_shards``
keeps them, with the shard in a column named by ``shard_col``, which must not be one of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_for, cell_of, checkpoint, repeated, row_keys, shuffle_key


def _before(counts: DataFrame, within: list[str], cell: str) -> DataFrame:
    """counts(within..., cell, in_cell) with ``before``, the rows in earlier cells, and ``total``."""
    whole = Window.partitionBy(*within)
    past = whole.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("in_cell").over(past), F.lit(0))).withColumn("total", F.sum("in_cell").over(whole))


def fractional_ranks(rows: DataFrame, *, seed: int, count: int, per_cell: int) -> DataFrame:
    """rows(name, none, k1, k2, ordinal, ...) with key, and frac, between 0 and 1: the place of a row in its source's seeded shuffle, less the source's phase."""
    bits = bits_for(count, per_cell)
    keyed = rows.withColumn("key", shuffle_key(seed, "k1", "k2", "ordinal")).withColumn("cell", cell_of(F.col("key"), bits))
    cells = ["name", "none", "cell"]
    counts = _before(keyed.groupBy(*cells).agg(F.count("*").alias("in_cell")), ["name", "none"], "cell")
    ranked = keyed.withColumn("local", F.row_number().over(Window.partitionBy(*cells).orderBy("key"))).join(counts, cells)
    phase = (F.conv(F.substring(shuffle_key(seed, "none", "name"), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return ranked.withColumn("frac", (F.col("before") + F.col("local") - phase) / F.col("total")).drop("in_cell", "before", "total", "local", "cell")


def _places(docs: DataFrame, *, n_shards: int, seed: int, id_col: str, text_col: str, source_col: str, per_cell: int) -> DataFrame:
    """One row per row of ``docs``: k1, k2 (equal for equal rows), id, name, none, size, text_crc32, shard, slot."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A source's name and whether it is null make a key without nulls, for plain equi-joins.
    narrow = docs.select(*row_keys(docs), F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.col(source_col).isNull().alias("none"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    same = [F.first(c).alias(c) for c in narrow.columns if c not in ("k1", "k2")]
    narrow = checkpoint(narrow.groupBy("k1", "k2").agg(*same, F.count("*").alias("n")))
    rows = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = bits_for(rows, per_cell)
    ranked = fractional_ranks(repeated(narrow, "n", "k1", "k2").drop("n"), seed=seed, count=rows, per_cell=per_cell)
    dealt = ranked.withColumn("slice", F.floor(F.col("frac") * (1 << bits)).cast("int"))
    counts = dealt.groupBy("slice").agg(F.count("*").alias("in_slice"))
    past = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each slice, a million at most.
    starts = counts.select("slice", F.coalesce(F.sum("in_slice").over(past), F.lit(0)).alias("before"))
    local = Window.partitionBy("slice").orderBy("frac", "none", "name", "key")
    placed = dealt.withColumn("local", F.row_number().over(local)).join(starts, "slice").withColumn("place", F.col("before") + F.col("local") - 1)
    placed = placed.withColumn("shard", F.expr(f"(place * {n_shards}) div {max(1, rows)}").cast("int"))
    first = F.expr(f"(shard * {rows} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", (F.col("place") - first).cast("long")).select("k1", "k2", "id", "name", "none", "size", "text_crc32", "shard", "slot")


def stratified_shards(docs: DataFrame, *, n_shards: int = 16, seed: int = 20_240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_cell: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, source, size (UTF-8 bytes plus 1), text_crc32, shard, slot.

    ``per_cell`` is the number of rows that one sorting cell is meant to hold. Up to a
    million cells are used; beyond that they grow.
    """
    placed = _places(docs, n_shards=n_shards, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, per_cell=per_cell)
    placed = placed.withColumn("name", F.when(~F.col("none"), F.col("name")))
    return placed.select(F.col("id").alias(id_col), F.col("name").alias(source_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, *, n_shards: int = 16, seed: int = 20_240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_cell: int = 512, shard_col: str = "shard", rows_a_file: int = 100_000) -> None:
    """Write the rows of ``docs`` into folders shard=0, shard=1, ... in slot order."""
    if shard_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {shard_col} already; name another shard_col")
    placed = _places(docs, n_shards=n_shards, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, per_cell=per_cell).select("k1", "k2", "shard", "slot")
    rows = docs.select(F.struct("*").alias("row"), *row_keys(docs)).dropDuplicates(["k1", "k2"])
    out = placed.join(rows, ["k1", "k2"]).withColumn("file", F.floor(F.col("slot") / rows_a_file))
    out = out.repartition("shard", "file").sortWithinPartitions("shard", "slot")
    out.select(F.col("row.*"), F.col("shard").alias(shard_col)).write.partitionBy(shard_col).mode("overwrite").parquet(path)
