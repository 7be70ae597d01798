"""Synthetic transfers with planted typologies, around actors that are given or numbered.

Every actor is a row; its transfers are exploded from a sequence, their times are running
sums of random gaps in whole microseconds, and amounts along a peel chain are running products. A draw
is the MD5 of the seed and of what it belongs to, so that it never depends on partitioning and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS

# Typology, prefix of its entities, actors of 450, transfers at least and at most (a mixer's are drawn apart), gap in seconds at least and at most.
KINDS = (
    ("none", "benign", 400, 2, 12, 2 * 3600, 48 * 3600),
    ("peel_chain", "peel", 15, 5, 10, 60, 480),
    ("mixer_fan_in_out", "mixer", 15, 12, 30, 30, 300),
    ("structuring", "struct", 10, 8, 20, 3600, 6 * 3600),
    ("ip_hopping", "hop", 10, 8, 15, 3600, 10 * 3600),
)
ACTORS = sum(k[2] for k in KINDS)
START = "2026-01-01 00:00:00"


def _unit(seed: int, *parts: Column) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(head, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _between(u: Column, low, high) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(u * (high - low + 1))).cast("long")


def _wallet(seed: int, *parts: Column) -> Column:
    return F.concat(F.lit("1"), F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 33))


def _ip(seed: int, *parts: Column) -> tuple[Column, Column]:
    """An address in one of eight blocks, and the block's network."""
    block = _between(_unit(seed, *parts, F.lit("block")), 0, 7)
    host = _between(_unit(seed, *parts, F.lit("host")), 1, 65534)
    address = F.concat_ws(".", (50 + 9 * block).cast("string"), (100 + block).cast("string"), F.floor(host / 256).cast("string"), (host % 256).cast("string"))
    return address, F.concat(F.lit("AS"), (1000 + block).cast("string"))


def actors(numbers: DataFrame, seed: int = DEFAULTS.seed) -> DataFrame:
    """numbers(number) -> what each actor is and does; of every 450 consecutive numbers each kind has its share."""
    at, kind = F.col("number") % ACTORS, None
    upto = ACTORS
    for typology, prefix, n, *rest in reversed(KINDS):
        row = F.struct(F.lit(typology).alias("typology"), F.lit(prefix).alias("prefix"), *[F.lit(v).cast("long").alias(c) for c, v in zip(("low", "high", "gap_low", "gap_high"), rest, strict=True)])
        upto -= n
        kind = row if kind is None else F.when(at < upto + n, row).otherwise(kind)
    rows = numbers.select("number", kind.alias("k")).select(F.concat_ws("_", "k.prefix", F.lpad(F.col("number").cast("string"), 9, "0")).alias("entity_id"), "k.*").drop("prefix")
    e, mixer = F.col("entity_id"), F.col("typology") == "mixer_fan_in_out"
    n_in = _between(_unit(seed, e, F.lit("in")), 6, 15)
    return rows.withColumns({
        "n_in": n_in,
        "n": F.when(mixer, n_in + _between(_unit(seed, e, F.lit("out")), 6, 15)).otherwise(_between(_unit(seed, e, F.lit("n")), F.col("low"), F.col("high"))),
        "wallets_n": F.when(F.col("typology") == "none", _between(_unit(seed, e, F.lit("w")), 1, 3)).otherwise(1),
        "start_us": F.floor(_unit(seed, e, F.lit("start")) * float(60 * 86400 * 1_000_000)).cast("long"),
        "start_amount": 5 + 15 * _unit(seed, e, F.lit("amount")),
    })


def transfers(who: DataFrame, seed: int = DEFAULTS.seed) -> tuple[DataFrame, DataFrame]:
    """actors -> (transactions, ground truth)."""
    e, mixer, peel, plain = F.col("entity_id"), F.col("typology") == "mixer_fan_in_out", F.col("typology") == "peel_chain", F.col("typology") == "none"
    steps = who.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    s = F.col("step")
    gap = F.col("gap_low") + (F.col("gap_high") - F.col("gap_low")) * _unit(seed, e, s, F.lit("gap"))
    gap = F.when(mixer & (s == F.col("n_in") + 1), 300 + 900 * _unit(seed, e, F.lit("pause"))).otherwise(gap)
    run = Window.partitionBy("entity_id").orderBy("step")  # at most 30 rows
    steps = steps.withColumn("gap_us", F.floor(gap * 1e6).cast("long")).withColumn("at_us", F.col("start_us") + F.sum("gap_us").over(run))
    held = F.aggregate(F.sequence(F.lit(1), s), F.col("start_amount"), lambda x, k: x * (0.85 + 0.10 * _unit(seed, e, k, F.lit("kept"))))
    own = _wallet(seed, e, F.lit("own"), F.floor(_unit(seed, e, s, F.lit("which")) * F.col("wallets_n")).cast("long"))
    main, other = _wallet(seed, e, F.lit("own"), F.lit("0")), _wallet(seed, e, F.lit("other"), s)
    link = lambda k: _wallet(seed, e, F.lit("chain"), k)
    comes_in = mixer & (s <= F.col("n_in"))
    u = _unit(seed, e, s, F.lit("size"))
    amount = F.when(plain, 0.001 + 1.999 * u).when(peel, held).when(mixer, 0.01 + 0.29 * u).when(F.col("typology") == "structuring", 0.05 + 0.04 * u).otherwise(0.01 + 0.99 * u)
    address, asn = _ip(seed, e, F.when(F.col("typology").isin("none", "structuring"), F.lit(0)).otherwise(s))
    tx = steps.select(
        F.sha2(F.concat_ws("|", F.lit(str(seed)), e, s.cast("string")), 256).alias("tx_id"),
        F.expr(f"timestamp_ntz'{START}' + make_dt_interval(0, 0, 0, cast(at_us / cast(1000000 as decimal(18,0)) as decimal(18,6)))").alias("timestamp"),
        F.when(peel, link(s - 1)).when(comes_in, other).when(plain, own).otherwise(main).alias("src_wallet"),
        F.when(peel, link(s)).when(comes_in, main).otherwise(other).alias("dst_wallet"),
        (F.floor(amount * 1e8).cast("double") / 1e8).alias("amount_btc"), address.alias("broadcast_ip"), asn.alias("asn"),
    )
    n = F.col("n").cast("int")
    chain = F.transform(F.sequence(F.lit(0), n), link)
    benign = F.transform(F.sequence(F.lit(0), F.col("wallets_n").cast("int") - 1), lambda k: _wallet(seed, e, F.lit("own"), k))
    receivers = F.transform(F.sequence(F.lit(1), n), lambda k: _wallet(seed, e, F.lit("other"), k))
    wallets = F.when(peel, chain).when(plain, benign).when(F.col("typology") == "structuring", F.concat(F.array(main), receivers)).otherwise(F.array(main))
    return tx, who.select(e, F.array_join(wallets, ";").alias("wallets"), (~plain).alias("is_illicit"), "typology")


def generate(spark: SparkSession, seed: int = DEFAULTS.seed, scale: int = 1) -> tuple[DataFrame, DataFrame]:
    """(transactions, ground truth) of 450 actors times ``scale``."""
    return transfers(actors(spark.range(ACTORS * scale).withColumnRenamed("id", "number"), seed), seed)


def _sql_unit(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{DEFAULTS.seed}', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _sql_between(u: str, low: str, high: str) -> str:
    return f"CAST({low} + floor({u} * ({high} - {low} + 1)) AS BIGINT)"


def _sql_wallet(*parts: str) -> str:
    return f"('1' || substr(sha256(concat_ws('|', '{DEFAULTS.seed}', {', '.join(parts)})), 1, 33))"


def synth_sql(numbers: str) -> str:
    """CTEs stx and struth: the same transactions and ground truth for ``numbers``, a query with a column number."""
    rows = ", ".join(f"('{t}', '{p}', {sum(k[2] for k in KINDS[:i])}, {sum(k[2] for k in KINDS[: i + 1])}, {', '.join(map(str, rest))})" for i, (t, p, _, *rest) in enumerate(KINDS))
    e, home = "entity_id", "CASE WHEN typology IN ('none', 'structuring') THEN 0 ELSE step END"
    block, host = _sql_between(_sql_unit(e, home, "'block'"), "0", "7"), _sql_between(_sql_unit(e, home, "'host'"), "1", "65534")
    size, main = _sql_unit(e, "step", "'size'"), _sql_wallet(e, "'own'", "0")
    return f"""
kind(typology, prefix, first, upto, low, high, gap_low, gap_high) AS (VALUES {rows}),
named AS (SELECT prefix || '_' || lpad(CAST(number AS VARCHAR), 9, '0') AS entity_id, kind.* FROM ({numbers}) JOIN kind ON number % {ACTORS} >= first AND number % {ACTORS} < upto),
inward AS (SELECT *, {_sql_between(_sql_unit(e, "'in'"), "6", "15")} AS n_in FROM named),
actor AS (
  SELECT *, CASE WHEN typology = 'mixer_fan_in_out' THEN n_in + {_sql_between(_sql_unit(e, "'out'"), "6", "15")} ELSE {_sql_between(_sql_unit(e, "'n'"), "low", "high")} END AS n,
         CASE WHEN typology = 'none' THEN {_sql_between(_sql_unit(e, "'w'"), "1", "3")} ELSE 1 END AS wallets_n,
         CAST(floor({_sql_unit(e, "'start'")} * 5184000000000.0::DOUBLE) AS BIGINT) AS start_us, 5 + 15 * {_sql_unit(e, "'amount'")} AS start_amount FROM inward),
steps AS (SELECT *, unnest(generate_series(1, n)) AS step FROM actor),
gapped AS (
  SELECT *, CAST(floor(CASE WHEN typology = 'mixer_fan_in_out' AND step = n_in + 1 THEN 300 + 900 * {_sql_unit(e, "'pause'")} ELSE gap_low + (gap_high - gap_low) * {_sql_unit(e, "step", "'gap'")} END * 1e6::DOUBLE) AS BIGINT) AS gap_us FROM steps),
timed AS (
  SELECT *, CAST(start_us + sum(gap_us) OVER (PARTITION BY entity_id ORDER BY step) AS BIGINT) AS at_us, {block} AS block, {host} AS host,
         list_reduce(list_transform(generate_series(0, step), lambda k: CASE WHEN k = 0 THEN start_amount ELSE 0.85::DOUBLE + 0.10::DOUBLE * {_sql_unit(e, "k", "'kept'")} END), lambda x, y: x * y) AS held FROM gapped),
stx AS (
  SELECT sha256(concat_ws('|', '{DEFAULTS.seed}', entity_id, step)) AS tx_id, TIMESTAMP '{START}' + to_microseconds(at_us) AS "timestamp",
         CASE WHEN typology = 'peel_chain' THEN {_sql_wallet(e, "'chain'", "step - 1")} WHEN typology = 'mixer_fan_in_out' AND step <= n_in THEN {_sql_wallet(e, "'other'", "step")}
              WHEN typology = 'none' THEN {_sql_wallet(e, "'own'", f"CAST(floor({_sql_unit(e, 'step', "'which'")} * wallets_n) AS BIGINT)")} ELSE {main} END AS src_wallet,
         CASE WHEN typology = 'peel_chain' THEN {_sql_wallet(e, "'chain'", "step")} WHEN typology = 'mixer_fan_in_out' AND step <= n_in THEN {main} ELSE {_sql_wallet(e, "'other'", "step")} END AS dst_wallet,
         floor(CASE typology WHEN 'none' THEN 0.001::DOUBLE + 1.999::DOUBLE * {size} WHEN 'peel_chain' THEN held WHEN 'mixer_fan_in_out' THEN 0.01::DOUBLE + 0.29::DOUBLE * {size}
               WHEN 'structuring' THEN 0.05::DOUBLE + 0.04::DOUBLE * {size} ELSE 0.01::DOUBLE + 0.99::DOUBLE * {size} END * 1e8::DOUBLE) / 1e8::DOUBLE AS amount_btc,
         concat_ws('.', 50 + 9 * block, 100 + block, host // 256, host % 256) AS broadcast_ip, 'AS' || (1000 + block) AS asn FROM timed),
struth AS (
  SELECT entity_id, typology <> 'none' AS is_illicit, typology, array_to_string(CASE typology
           WHEN 'peel_chain' THEN list_transform(generate_series(0, n), lambda k: {_sql_wallet(e, "'chain'", "k")})
           WHEN 'none' THEN list_transform(generate_series(0, wallets_n - 1), lambda k: {_sql_wallet(e, "'own'", "k")})
           WHEN 'structuring' THEN list_concat([{main}], list_transform(generate_series(1, n), lambda k: {_sql_wallet(e, "'other'", "k")}))
           ELSE [{main}] END, ';') AS wallets FROM actor)
"""
