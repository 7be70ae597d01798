"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint takes, bit by bit, the majority over the XXH64 hashes of its
3-word shingles. Fingerprints link at Hamming distance 2 or less. Two fingerprints that
close have a 32-bit half in which they differ in at most one bit. So each distinct
fingerprint is filed in one table per half under that half's value, looks up the
radius-1 ball around each half, and every match is checked in full. Of a pair that
differs in one bit of a half, only the side with the bit set looks up the other one,
which halves the ball.

A half that very many distinct fingerprints share would yield a number of candidates that
grows with the square. Fingerprints that meet in such a bucket are linked exactly in
another way: two words are within distance 2 if and only if their full radius-1 balls
meet, so each fingerprint files its 65 neighbours and everything filed under one
neighbour is tied to its smallest member.

Copies count once: all work is on distinct fingerprints, each with its smallest id.

Defined cases: null and blank texts have fingerprint zero and link like any other; texts
of one or two words are one shingle; repeated rows are copies; rows with a null id
stay, linked by fingerprint, but do not name a component; texts of any length are hashed whole;
empty tables give empty results; ``simhash_components`` passes other columns by and
``deduplicated`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import ship
from .common import checkpoint, row_keys

SEED = 42
#: Distinct fingerprints in one table bucket beyond which the bucket is linked through shared neighbours.
HOT_BUCKET = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of one text, as an unsigned 64-bit integer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    hashes = np.array([digest(view[s:e], SEED) for s, e in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch)).view(np.int64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(_fingerprints, "long")(F.col(text_col)).alias("fp"))


def _halves(fp: str) -> list:
    return [F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))]


def near_links(distinct: DataFrame, *, distance: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """distinct(fp) -> (a, b): edges that join all fingerprints within ``distance`` (0 to 2).

    All pairs within the distance are reached along edges, and no edge exceeds it.
    """
    if not 0 <= distance <= 2:
        raise ValueError("two tables with radius-1 look-ups find distances of 2 and less")
    one = F.lit(1).cast("long")
    halves = F.array(*[F.struct(F.lit(i).alias("side"), h.alias("half")) for i, h in enumerate(_halves("fp"))])
    filed = distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.side", "h.half")
    # The half's own value, and the value without each of its set bits.
    lower = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("half").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i)))), lambda v: v != F.col("half"))
    asked = filed.select(F.col("fp").alias("asker"), "side", F.explode(F.concat(F.array("half"), lower)).alias("half"))
    crowded = filed.groupBy("side", "half").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket)
    table = filed.join(crowded.select("side", "half", F.lit(True).alias("hot")), ["side", "half"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # A crowded bucket answers with one row that says so.
    answers = table.where("not hot").select("side", "half", "fp", "hot").unionByName(crowded.select("side", "half", F.lit(None).cast("long").alias("fp"), F.lit(True).alias("hot")))
    met = asked.join(answers, ["side", "half"])
    near = F.bit_count(F.col("asker").bitwiseXOR(F.col("fp"))) <= distance
    found = checkpoint(met.where(F.col("hot") | (near & (F.col("asker") != F.col("fp")))).select("asker", "fp", "hot").distinct())
    direct = found.where("not hot").select(F.col("asker").alias("a"), F.col("fp").alias("b"))
    inside = table.where("hot").select(F.col("fp").alias("asker"))
    members = found.where("hot").select("asker").union(inside).distinct()
    if distance < 2:
        # Distance 1: the two differ in one bit, so that one of them is the other's neighbour.
        ball = F.concat(F.array(F.col("asker")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("asker").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i)))))
        around = members.select(F.col("asker").alias("a"), F.explode(ball).alias("b")).distinct() if distance else members.select(F.col("asker").alias("a"), F.col("asker").alias("b"))
        stars = around.join(members.withColumnRenamed("asker", "b"), "b", "left_semi").where("a <> b")
    else:
        ball = F.concat(F.array(F.col("asker")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("asker").bitwiseXOR(F.call_function("shiftleft", one, i))))
        around = members.select(F.col("asker").alias("a"), F.explode(ball).alias("point"))
        centre = around.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b <> top").select("point", "b")
        stars = around.join(centre, "point").where("a <> b").select("a", "b")
    return direct.unionByName(stars.select("a", "b"))


def _fingerprint_components(classes: DataFrame, *, distance: int, hot_bucket: int) -> DataFrame:
    """``classes`` (one row per fp) with the fingerprint that names the component of each."""
    parts = connected_components(near_links(classes.select("fp"), distance=distance, hot_bucket=hot_bucket))
    return classes.join(parts, classes.fp == parts.id, "left").select(*classes.columns, F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, *, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id (smallest id reachable)."""
    prints = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    named = _fingerprint_components(classes, distance=distance, hot_bucket=hot_bucket)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    owners = named.join(smallest, "component").select(F.col("fp").alias("of"), "component_id")
    return prints.join(owners, prints.fp == owners.of).select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that with the smallest id.

    Rows of a component that share that id go by a hash of the row, and of equal rows one stays.
    A row with a null id stays only if its component has no other. Components do not touch
    each other: unrelated texts stay although their ids are null or the same.
    """
    ship(docs.sparkSession)
    keys = row_keys(docs)
    prints = docs.select(F.col(id_col).alias("id"), F.pandas_udf(_fingerprints, "long")(F.col(text_col)).alias("fp"), *keys)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2")).alias("first")
    classes = checkpoint(prints.groupBy("fp").agg(first))
    named = _fingerprint_components(classes, distance=distance, hot_bucket=HOT_BUCKET)
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    # Whole rows travel as one struct, so that no name of theirs meets one of these.
    rows = docs.select(F.struct("*").alias("row"), *keys).join(kept, ["k1", "k2"], "left_semi")
    return rows.dropDuplicates(["k1", "k2"]).select("row.*")
