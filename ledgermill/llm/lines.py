"""Cross-site line deduplication by distinct-site spread.

Every line is hashed, and one HyperLogLog sketch per line hash gathers the sites that
have it; partial sketches merge on the map side, so a line on every page of every site
costs one row per task. Lines whose estimate lies clearly above ``min_sites`` are
boilerplate, clearly below are not, and those in between have their sites counted
exactly. Boilerplate lines are then removed from every text.

Texts are not taken apart and put together again across the network: a document gets
the set of its own boilerplate hashes by one join, and filters its lines in place.
Everything is built-in functions.

A line is compared without the spaces, tabs and carriage returns at its ends. Lines of fewer than ``min_chars``
characters stay.

Defined cases: a null text stays null and has no lines; an empty text has one empty line, which
stays; a null site counts as one more site; a line repeated within a site counts once;
repeated rows and rows that share an id lose the same lines; a text may be left empty, and its
row stays; an empty table gives an empty result; other columns are kept by
``without_boilerplate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint

MIN_SITES = 10
MIN_CHARS = 8
#: Sketches of 2^10 registers have a standard error of about 3 %; estimates within 15 % are counted.
LG_REGISTERS = 10
NEAR = 0.15


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def line_hashes(docs: DataFrame, *, text_col: str, min_chars: int, **carried: Column) -> DataFrame:
    """(carried..., h): one row per line of at least ``min_chars`` characters."""
    lines = docs.select(*[c.alias(n) for n, c in carried.items()], F.explode(_lines(F.col(text_col))).alias("line"))
    bare = _bare(F.col("line"))
    return lines.where(F.length(bare) >= min_chars).select(*carried, F.xxhash64(bare).alias("h"))


def boilerplate(docs: DataFrame, *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text_col: str = "text", site_col: str = "source", lg_registers: int = LG_REGISTERS, near: float = NEAR) -> DataFrame:
    """(h, sites, counted): hashes of the lines that at least ``min_sites`` sites have.

    ``counted`` tells an exact count from an estimate.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("none"))
    lines = line_hashes(docs, text_col=text_col, min_chars=min_chars, site=site)
    spread = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_registers)).alias("sketch"))
    # A line on k sites occurs k times at least.
    judged = spread.where(F.col("n") >= min_sites).select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - near))
    judged = checkpoint(judged.withColumn("sure", F.col("sites") > min_sites * (1 + near)))
    unsure = broadcast_if_small(judged.where("not sure").select("h"))
    counts = lines.join(unsure, "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("sites"))
    exact = counts.where(F.col("sites") >= min_sites).select("h", F.col("sites").cast("long"), F.lit(True).alias("counted"))
    return judged.where("sure").select("h", F.col("sites").cast("long"), F.lit(False).alias("counted")).unionByName(exact)


def _own_boilerplate(docs: DataFrame, *, id_col: str, text_col: str, site_col: str, min_sites: int, min_chars: int) -> DataFrame:
    """(key, gone): for each id of ``docs`` the hashes of the lines to remove, where there are any."""
    known = broadcast_if_small(boilerplate(docs, min_sites=min_sites, min_chars=min_chars, text_col=text_col, site_col=site_col).select("h"))
    hits = line_hashes(docs, text_col=text_col, min_chars=min_chars, key=F.col(id_col)).join(known, "h", "left_semi")
    return hits.groupBy("key").agg(F.collect_set("h").alias("gone"))


def _stays(line: Column, gone: Column, min_chars: int) -> Column:
    return ~((F.length(_bare(line)) >= min_chars) & F.array_contains(gone, F.xxhash64(_bare(line))))


def _kept(text: Column, gone: Column, min_chars: int) -> Column:
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(_lines(text), lambda line: _stays(line, gone, min_chars)), "\n"))


def without_boilerplate(docs: DataFrame, *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text_col``; all rows and columns stay."""
    gone = _own_boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, min_chars=min_chars)
    # Whole rows travel as one struct, so that no name of theirs meets one of these.
    rows = docs.select(F.struct("*").alias("row"))
    value = lambda c: F.col("row").getField(c)
    marked = rows.join(gone, value(id_col).eqNullSafe(F.col("key")), "left")
    return marked.select(*[(_kept(value(c), F.col("gone"), min_chars) if c == text_col else value(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, kept_sha256 (null for a null text)."""
    gone = _own_boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, min_chars=min_chars)
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(gone, F.col("id").eqNullSafe(F.col("key")), "left")
    text, found = F.col("text"), F.col("gone")
    lines = F.coalesce(F.size(_lines(text)), F.lit(0))
    removed = F.when(found.isNull(), F.lit(0)).otherwise(lines - F.size(F.filter(_lines(text), lambda line: _stays(line, found, min_chars))))
    return marked.select(F.col("id").alias(id_col), lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.sha2(F.encode(_kept(text, found, min_chars), "UTF-8"), 256).alias("kept_sha256"))
