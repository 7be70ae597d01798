"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, materialize

#: Largest table, in rows, that may be broadcast; its size is measured first.
BROADCAST_ROWS = 20_000


_resident: dict = {}


def resident(key, make):
    """The one model that a Python worker keeps between tasks: that of ``key``, made if another one was there."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame) -> list[Column]:
    """k1 and k2: 128 bits of hash over all columns, in which a null counts apart from a value that is left out."""
    flat = lambda c, t: F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "<" in t or t == "variant" else c
    values = [x for name, t in docs.dtypes for c in [F.col(f"`{name}`")] for x in (c.isNull(), flat(c, t))]
    return [F.xxhash64(F.lit(1), *values).alias("k1"), F.xxhash64(*reversed(values), F.lit(2)).alias("k2")]


#: Copies of one row that one task writes out; more are dealt to several tasks.
COPIES = 1000


def repeated(df: DataFrame, times: str, *key: str) -> DataFrame:
    """``df`` with each row as often as ``times`` says, and ``ordinal`` from 0; ``key`` tells rows apart."""
    few = df.where(F.col(times).between(1, COPIES)).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))
    many = df.where(F.col(times) > COPIES).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {COPIES}"))))
    many = many.repartition(*key, "chunk").withColumn("begin", F.col("chunk") * COPIES)
    many = many.withColumn("ordinal", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col(times).cast("long")) - 1)))
    return few.unionByName(many.drop("chunk", "begin"))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` cut off from its lineage, marked for broadcast if its counted rows stay below ``limit``."""
    df = checkpoint(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of one key beyond which it is joined apart from the others.
HOT_KEY = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: int = HOT_KEY) -> DataFrame:
    """``left`` joined with ``right``, a written table with one row per key and ``times``, the rows of ``left`` with that key.

    Rows with a frequent key are not brought together: those keys, few in number, go to where the rows are.
    ``how``: inner or left_anti.
    """
    many, few = broadcast_if_small(right.where(F.col("times") > hot)), right.where(F.col("times") <= hot)
    if how == "left_anti":
        return left.join(many, on, "left_anti").join(few, on, "left_anti")
    return left.join(many, on).unionByName(left.join(many, on, "left_anti").join(few, on))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression (lambda bodies have no common-subexpression elimination)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bits_for(rows: int, per_cell: int, least: int = 4, most: int = 20) -> int:
    """log2 of the number of cells that hold about ``per_cell`` of ``rows`` each."""
    return min(most, max(least, math.ceil(math.log2(max(2, rows / per_cell)))))


def shuffle_key(seed: int, *cols: str) -> Column:
    """A hexadecimal digest that orders rows by a seeded shuffle; nulls have a place of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))


def cell_of(key: Column, bits: int) -> Column:
    """The cell of a digest: its leading ``bits`` bits (32 at most)."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(head, 32 - bits).cast("int")


__all__ = ["BROADCAST_ROWS", "COPIES", "HOT_KEY", "bits_for", "broadcast_if_small", "cell_of", "checkpoint", "join_hot", "let", "materialize", "repeated", "resident", "row_keys", "shuffle_key", "table"]
