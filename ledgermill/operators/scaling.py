"""Standardisation and min-max normalisation by one global aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import EPSILON


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """column -> (mean, population standard deviation, 1 where it is 0)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column less its mean, over its population standard deviation."""
    scale = moments(df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def min_max_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column scaled to 0 up to 1, all by one aggregate; a constant column becomes 0."""
    row = df.agg(*[F.min(c).alias(f"low_{c}") for c in columns], *[F.max(c).alias(f"high_{c}") for c in columns]).first()
    ends = {c: (0.0, 0.0) if row[f"low_{c}"] is None else (float(row[f"low_{c}"]), float(row[f"high_{c}"])) for c in columns}
    return df.withColumns({c: (F.col(c) - F.lit(low)) / F.lit(high - low + EPSILON) for c, (low, high) in ends.items()})


def min_max(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """``df`` with a column scaled to 0 up to 1; a constant column becomes 0."""
    if into in (None, column):
        return min_max_all(df, [column])
    return min_max_all(df.withColumn(into, F.col(column)), [into])
