"""Timestamps and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Date, or date and time with optional seconds, fraction and offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds with a fraction, for timestamps with or without time zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def time_slice(ts: Column, seconds: int) -> Column:
    """The number of the stretch of ``seconds`` that a timestamp without time zone falls in."""
    return F.floor(micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), ts) / F.lit(seconds * 1_000_000)).cast("long")


def gaps(rows: DataFrame, *by: str, ts: str = "timestamp", seconds: int = 3600) -> DataFrame:
    """(by, gap_us): the time from each row to the next one with the same ``by``, in microseconds, but for the first.

    Rows are ordered within stretches of ``seconds``, and the ends of successive stretches are
    stitched, so that no task orders all rows of one key. Rows without ``by`` or ``ts`` take no part.
    """
    rows = rows.select(*by, F.col(ts).alias("ts")).dropna().withColumn("slice", time_slice(F.col("ts"), seconds)).repartition(*by, "slice")
    # Sorted by slice first, since names of entities begin alike.
    own = Window.partitionBy("slice", *by).orderBy("ts")
    # Dealt once: the gaps within a slice and its ends come from the same shuffle, and the latter need no partial sums of it.
    inner = rows.select(*by, micros_between(F.lag("ts").over(own), F.col("ts")).alias("gap_us"))
    ends = rows.groupBy(*by, "slice").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    between = ends.select(*by, micros_between(F.lag("high").over(Window.partitionBy(*by).orderBy("slice")), F.col("low")).alias("gap_us"))
    return inner.unionByName(between).where("gap_us is not null")


def utc_ntz(ts: Column) -> Column:
    """An instant as a timestamp without time zone in UTC, whatever the session's zone."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def parse_iso(text: Column) -> Column:
    """ISO-8601 text as a timestamp without time zone, in UTC; null if it is none."""
    clean = F.replace(text, F.lit(","), F.lit("."))
    zoned = clean.rlike(r"[T ].*" + _OFFSET)
    return F.when(text.rlike(ISO), F.when(zoned, utc_ntz(clean.try_cast("timestamp"))).otherwise(clean.try_cast("timestamp_ntz")))


def parse_epoch(seconds: Column) -> Column:
    """Epoch seconds as a timestamp without time zone, in UTC."""
    return utc_ntz(F.timestamp_micros(F.round(seconds * 1e6).cast("long")))


def iso_text(ts: Column) -> Column:
    """The text form: seconds, and microseconds if there are any."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", plain).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
