"""Validation and normalisation of raw records.

One expression names the first rule that a record breaks, or null; clean rows and
rejects are two filters over the same lazily evaluated table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import parse_epoch, parse_iso
from ..settings import CANONICAL_FIELDS

#: Numbers as text: no underscores, no type suffixes; infinities and not-a-number pass.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
_EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def amount_of(text: Column) -> Column:
    word = F.lower(strip(text))
    special = F.when(word.rlike("^[+]?inf"), F.lit(float("inf"))).when(word.rlike("^-inf"), F.lit(float("-inf"))).when(word.rlike("nan"), F.lit(float("nan")))
    return F.when(text.rlike(NUMBER), F.coalesce(special, word.try_cast("double")))


def tag(raw: DataFrame) -> DataFrame:
    """``raw`` with reject_reason and the normalised values in columns named ``_clean_*``."""
    raw = raw if "_numeric" in raw.columns else raw.withColumn("_numeric", F.array().cast("array<string>"))
    for f in CANONICAL_FIELDS:
        if f not in raw.columns:
            raw = raw.withColumn(f, F.lit(None).cast("string"))
    text = {f: F.col(f).cast("string") for f in CANONICAL_FIELDS}
    numeric_time = F.coalesce(F.array_contains("_numeric", "timestamp"), F.lit(False))
    epoch = parse_epoch(F.when(text["timestamp"] == "true", 1.0).when(text["timestamp"] == "false", 0.0).otherwise(text["timestamp"].try_cast("double")))
    when = F.when(numeric_time, epoch).otherwise(parse_iso(text["timestamp"]))
    boolean = F.when(text["amount_btc"] == "true", 1.0).when(text["amount_btc"] == "false", 0.0)
    amount = F.when(F.array_contains("_numeric", "amount_btc"), F.coalesce(boolean, amount_of(text["amount_btc"]))).otherwise(amount_of(text["amount_btc"]))
    rules = [F.when(text[f].isNull() | (text[f] == ""), F.lit(f"missing required field: {f}")) for f in CANONICAL_FIELDS]
    rules.append(F.when(when.isNull(), F.lit("unparseable timestamp")))
    rules.append(F.when(amount.isNull(), F.lit("amount_btc is not numeric")))
    rules.append(F.when(amount <= 0, F.lit("amount_btc must be positive")))
    rules += [F.when(F.length(strip(text[f])) < 4, F.lit(f"{f} is too short")) for f in ("tx_id", "src_wallet", "dst_wallet")]
    rules.append(F.when(strip(text["src_wallet"]) == strip(text["dst_wallet"]), F.lit("self transfer: src_wallet equals dst_wallet")))
    clean = {"timestamp": when, "amount_btc": amount} | {f: strip(text[f]) for f in CANONICAL_FIELDS if f not in ("timestamp", "amount_btc")}
    return raw.withColumn("reject_reason", F.coalesce(*rules)).withColumns({f"_clean_{f}": c for f, c in clean.items()})


def _extra(tagged: DataFrame) -> list[str]:
    return [c for c in tagged.columns if c not in CANONICAL_FIELDS and not c.startswith("_") and c != "reject_reason"]


def clean_rows(tagged: DataFrame) -> DataFrame:
    """Accepted records in canonical types, with any further columns."""
    return tagged.where("reject_reason is null").select(*[F.col(f"_clean_{f}").alias(f) for f in CANONICAL_FIELDS], *_extra(tagged))


def rejected_rows(tagged: DataFrame) -> DataFrame:
    """Rejected records as they came, with reject_reason."""
    return tagged.where("reject_reason is not null").select(*CANONICAL_FIELDS, *_extra(tagged), "reject_reason")


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = tag(raw)
    return clean_rows(tagged), rejected_rows(tagged)
