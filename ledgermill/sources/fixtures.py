"""Transaction views of the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import cidr_bounds
from ..session import new_folder
from .readers import CIDR


def _padded(prefix: str, number, width: int):
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event. Some have the same wallet on both sides; validation rejects those."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    half = F.floor(F.col("user_id") / 2).cast("long")
    dotted = lambda head, a: F.concat(F.lit(head), F.floor(a / 250).cast("long").cast("string"), F.lit("."), (a % 250).cast("string"))
    block = F.floor(F.col("event_id") / 250).cast("long")
    error_ip = F.concat(F.lit("77.88."), (block % 250).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))
    return events.select(
        _padded("tx", F.col("event_id"), 10).alias("tx_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        _padded("W", F.col("user_id"), 7).alias("src_wallet"),
        F.when(k < 40, _padded("W", (F.col("user_id") + k) % n, 7)).otherwise(_padded("X", F.col("event_id") % (n * 20), 7)).alias("dst_wallet"),
        F.col("value").alias("amount_btc"),
        F.when(F.col("event_type") == "error", error_ip).otherwise(dotted("41.12.", half)).alias("broadcast_ip"),
        F.concat(F.lit("AS"), (1000 + k % 8).cast("string")).alias("asn"),
    )


TX_SQL = """
n AS (SELECT max(user_id) + 1 AS n FROM events),
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
tx AS (
  SELECT 'tx' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS tx_id, ts AS "timestamp",
         'W' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS src_wallet,
         CASE WHEN k < 40 THEN 'W' || lpad(CAST((user_id + k) % n AS VARCHAR), 7, '0')
              ELSE 'X' || lpad(CAST(event_id % (n * 20) AS VARCHAR), 7, '0') END AS dst_wallet,
         value AS amount_btc,
         CASE WHEN event_type = 'error' THEN '77.88.' || ((event_id // 250) % 250) || '.' || (event_id % 250)
              ELSE '41.12.' || ((user_id // 2) // 250) || '.' || ((user_id // 2) % 250) END AS broadcast_ip,
         'AS' || (1000 + k % 8) AS asn
  FROM e CROSS JOIN n)
"""

#: The rows that pass validation: positive amounts between two different wallets.
CLEAN_SQL = TX_SQL + ", clean AS (SELECT * FROM tx WHERE src_wallet <> dst_wallet AND NOT amount_btc <= 0)"


def clean(rows: DataFrame) -> DataFrame:
    return rows.where("src_wallet <> dst_wallet and not amount_btc <= 0")


def clean_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(tx(spark, sf_dir))


def mtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with several inputs: an order has one for each of its line items."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return item.select(
        F.concat(F.lit("ord"), F.col("l_orderkey").cast("string")).alias("tx_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        _padded("P", F.col("l_partkey"), 7).alias("src_wallet"),
        _padded("S", F.col("l_suppkey"), 7).alias("dst_wallet"),
        F.col("l_extendedprice").alias("amount_btc"),
        F.concat(F.lit("90.1."), F.floor(F.col("l_suppkey") / 250).cast("long").cast("string"), F.lit("."), (F.col("l_suppkey") % 250).cast("string")).alias("broadcast_ip"),
        F.concat(F.lit("AS"), (1000 + F.col("l_suppkey") % 8).cast("string")).alias("asn"),
    )


MTX_SQL = """
mtx AS (
  SELECT 'ord' || l_orderkey AS tx_id, l_shipdate AS "timestamp",
         'P' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS src_wallet, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS dst_wallet,
         l_extendedprice AS amount_btc, '90.1.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) AS broadcast_ip, 'AS' || (1000 + l_suppkey % 8) AS asn
  FROM lineitem)
"""

# (block, country, city, latitude, longitude, organisation)
_BLOCKS = (
    ("41.12.0.0/16", "ZA", "Cape Town", -33.9, 18.4, "South Net"),
    ("41.12.0.0/24", "ZA", None, -33.5, 18.0, "South Net"),
    ("41.12.1.0/24", "KE", "Nairobi", -1.3, 36.8, "East Net"),
    ("41.12.2.0/24", None, None, None, None, "Dark Net"),
    ("77.88.0.0/16", "RU", "Moscow", 55.8, 37.6, "North Net"),
    ("77.88.0.0/17", "RU", "Kazan", 55.8, 49.1, "North Net"),
    ("77.88.5.0/24", "FI", "Helsinki", 60.2, 24.9, "Baltic Net"),
    ("77.88.7.0/24", "FI", None, 61.0, 25.0, "Baltic Net"),
)


def _geo_rows() -> list[tuple]:
    return [(*cidr_bounds(b), int(b.split("/")[1]), *rest) for b, *rest in _BLOCKS]


def geo(spark: SparkSession) -> DataFrame:
    """A small CIDR table with overlapping blocks and missing cities."""
    return spark.createDataFrame(_geo_rows(), CIDR)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else f"{value}::DOUBLE" if isinstance(value, float) else str(value)


GEO_SQL = "geo(ip_start, ip_end, prefix, country, city, latitude, longitude, asn_org) AS (VALUES " + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in _geo_rows()) + ")"


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True entities with their wallets as a list in text."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    group = F.floor(F.col("user_id") / 20).cast("long")
    rows = users.groupBy(group.alias("g")).agg(F.array_join(F.sort_array(F.collect_set(_padded("W", F.col("user_id"), 7))), ";").alias("wallets"))
    kind = F.element_at(F.array(*[F.lit(t) for t in ("none", "peel_chain", "mixer_fan_in_out", "structuring", "ip_hopping")]), (F.col("g") % 5 + 1).cast("int"))
    return rows.select(F.concat(F.lit("true_"), F.col("g").cast("string")).alias("entity_id"), "wallets", (F.col("g") % 5 != 0).alias("is_illicit"), kind.alias("typology"))


GT_SQL = """
gt AS (
  SELECT 'true_' || g AS entity_id, string_agg(w, ';' ORDER BY w) AS wallets, g % 5 <> 0 AS is_illicit,
         (['none', 'peel_chain', 'mixer_fan_in_out', 'structuring', 'ip_hopping'])[g % 5 + 1] AS typology
  FROM (SELECT DISTINCT user_id // 20 AS g, 'W' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS w FROM events)
  GROUP BY g)
"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per signup event; the wallet stands for its entity. seq orders labels of one second."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    return rows.select(
        F.concat(F.lit("entity_"), _padded("W", F.col("user_id"), 7)).alias("entity_id"),
        (F.col("event_id") % 2).cast("int").alias("label"),
        F.lit("").alias("note"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("event_id").alias("seq"),
    )


FB_SQL = """
fb AS (
  SELECT 'entity_W' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS entity_id, CAST(event_id % 2 AS INTEGER) AS label, '' AS note,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", event_id AS seq
  FROM events WHERE event_type = 'signup')
"""


def dirty(spark: SparkSession, sf_dir: str, *, numbered: bool = False) -> DataFrame:
    """``tx`` as strings, with faults that follow from the event's number, which ``numbered`` keeps."""
    rows = tx(spark, sf_dir)
    m = F.substring("tx_id", 3, 10).cast("long") % 17
    fault = lambda n, bad, good: F.when(m == n, bad).otherwise(good)
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    amount = F.format_string("%d", F.floor(F.col("amount_btc") * 100).cast("long"))
    out = rows.select(
        fault(0, F.lit(""), F.col("tx_id")).alias("tx_id"),
        F.when(m == 2, F.lit("not-a-time")).when(m == 3, F.lit("2026-1-1")).otherwise(text).alias("timestamp"),
        F.when(m == 6, F.lit(" W1 ")).when(m == 7, F.concat(F.lit("  "), F.col("src_wallet"), F.lit("\t"))).otherwise(F.col("src_wallet")).alias("src_wallet"),
        F.when(m == 8, F.concat(F.lit(" "), F.col("src_wallet"))).otherwise(F.col("dst_wallet")).alias("dst_wallet"),
        F.when(m == 4, F.lit("0")).when(m == 5, F.lit("-1")).when(m == 9, F.lit("abc")).when(m == 10, F.lit("1_000")).otherwise(amount).alias("amount_btc"),
        F.when(m == 11, F.lit("  ")).otherwise(F.col("broadcast_ip")).alias("broadcast_ip"),
        F.when(m != 1, F.col("asn")).alias("asn"),
        *([F.substring("tx_id", 3, 10).cast("long").alias("number")] if numbered else []),
    )
    return out.withColumn("_numeric", F.array().cast("array<string>"))


#: Records in one JSON file of ``write_formats``.
LISTED = 5000


def write_formats(spark: SparkSession, sf_dir: str) -> list[str]:
    """``dirty`` in the shared folder, a third each as CSV, JSON lists and XML; JSON has numbers for valid amounts and times. -> the paths."""
    rows = dirty(spark, sf_dir, numbered=True).drop("_numeric")
    # A field that is none of the canonical ones, in three of five records.
    rows = rows.withColumn("memo", F.when(F.col("number") % 5 < 3, F.concat(F.lit("0"), (F.col("number") % 7).cast("string"))))
    third = lambda k: rows.where(F.col("number") % 3 == k)
    folder = new_folder(spark)
    paths = [f"{folder}/part.{kind}" for kind in ("csv", "json", "xml")]
    third(0).drop("number").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[0])
    amount, time = F.col("amount_btc").try_cast("long"), F.unix_timestamp(F.col("timestamp").try_cast("timestamp"))
    whole = F.when(F.length("timestamp") == 19, time)
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), F.replace(F.col(c), F.lit("\t"), F.lit("\\t")), F.lit('"')))
    parts = {c: quoted(c) for c in ("tx_id", "src_wallet", "dst_wallet", "broadcast_ip", "asn", "memo")} | {"timestamp": F.coalesce(whole.cast("string"), quoted("timestamp")), "amount_btc": F.coalesce(amount.cast("string"), quoted("amount_btc"))}
    record = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), v) for c, v in parts.items()]), F.lit("}"))
    listed = third(1).select(F.expr(f"number div {LISTED}").alias("file"), record.alias("r")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n "), F.lit("]")).alias("value"))
    listed.write.partitionBy("file").text(paths[1])
    third(2).drop("number").write.format("xml").option("rootTag", "transactions").option("rowTag", "transaction").save(paths[2])
    return paths


DIRTY_SQL = """
d0 AS (SELECT *, CAST(substr(tx_id, 3) AS BIGINT) % 17 AS m FROM tx),
dirty AS (
  SELECT CASE WHEN m = 0 THEN '' ELSE tx_id END AS tx_id,
         CASE WHEN m = 2 THEN 'not-a-time' WHEN m = 3 THEN '2026-1-1' ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S') END AS "timestamp",
         CASE WHEN m = 6 THEN ' W1 ' WHEN m = 7 THEN '  ' || src_wallet || chr(9) ELSE src_wallet END AS src_wallet,
         CASE WHEN m = 8 THEN ' ' || src_wallet ELSE dst_wallet END AS dst_wallet,
         CASE WHEN m = 4 THEN '0' WHEN m = 5 THEN '-1' WHEN m = 9 THEN 'abc' WHEN m = 10 THEN '1_000'
              ELSE CAST(CAST(floor(amount_btc * 100) AS BIGINT) AS VARCHAR) END AS amount_btc,
         CASE WHEN m = 11 THEN '  ' ELSE broadcast_ip END AS broadcast_ip,
         CASE WHEN m = 1 THEN NULL ELSE asn END AS asn
  FROM d0)
"""


# (network, country, city, latitude, longitude, organisation)
_NETWORKS = (
    ("41.12.0.0/16", "ZA", "Cape Town", -33.9, 18.4, "South Net"),
    ("41.12.1.0/24", "KE", "Nairobi", -1.3, 36.8, "East Net"),
    ("77.88.5.0/24", "FI", "Helsinki", 60.2, 24.9, "Baltic Net"),
    ("2a0c::/16", "SE", None, 59.3, 18.1, "Six Net"),
    ("2a0c:3::/32", "NO", "Oslo", 59.9, 10.7, "Fjord Net"),
    ("2a0c:3:0040::/42", "NO", "Bergen", 60.4, 5.3, "Fjord Net"),
    ("2a0c:5:8000::/33", "DK", "Aarhus", None, None, "Belt Net"),
    ("2A0C:7:1:0:0:0:0:80/121", "IS", "Akureyri", 65.7, -18.1, "Geyser Net"),
)


def networks(spark: SparkSession) -> DataFrame:
    """A small table of networks of both versions, with overlaps and missing values."""
    return spark.createDataFrame(list(_NETWORKS), "network string, country string, city string, latitude double, longitude double, asn_org string")


def mixed_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, broadcast_ip): an address for each event; two of three are IPv6, shortened or in full, and some are private."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")
    word = lambda x: F.lower(F.hex(x))
    a, b, c = word(event % 8), word(user % 65536), word(event % 65536)
    head = F.when(event % 11 == 0, "fd00").otherwise("2a0c")
    short, full = F.concat_ws(":", head, a, b, F.lit(""), c), F.concat_ws(":", F.upper(head), a, F.lpad(b, 4, "0"), F.lit("0"), F.lit("0000"), F.lit("0"), F.lit("0"), c)
    four = F.concat_ws(".", F.lit("41"), F.lit("12"), F.floor(user / 250).cast("string"), (user % 250).cast("string"))
    return events.select(_padded("tx", event, 10).alias("tx_id"), F.when(event % 3 == 0, short).when(event % 3 == 1, full).otherwise(four).alias("broadcast_ip"))


def _network_rows() -> list[str]:
    import ipaddress

    nets = [(ipaddress.ip_network(n, strict=False), *rest) for n, *rest in _NETWORKS]
    return [f"({n.version}, {int(n.network_address)}::HUGEINT, {int(n.broadcast_address)}::HUGEINT, {n.prefixlen}, {', '.join(_literal(v) for v in rest)})" for n, *rest in nets]


MIXED_SQL = f"""
net(version, low, high, prefix, country, city, latitude, longitude, asn_org) AS (VALUES {', '.join(_network_rows())}),
mixed AS (
  SELECT 'tx' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS tx_id, CASE WHEN event_id % 3 = 2 THEN 4 ELSE 6 END AS version, event_id % 11 = 0 AND event_id % 3 <> 2 AS private,
         CASE WHEN event_id % 3 = 2 THEN (41 * 65536 * 256 + 12 * 65536 + (user_id // 250) * 256 + user_id % 250)::HUGEINT
              ELSE (((10764::HUGEINT * 65536 + event_id % 8) * 65536 + user_id % 65536) * 65536 * 65536 * 65536 * 65536 * 65536) + event_id % 65536 END AS n
  FROM events),
placed AS (SELECT tx_id, net.*, row_number() OVER (PARTITION BY tx_id ORDER BY prefix DESC) AS r FROM mixed JOIN net ON net.version = mixed.version AND n BETWEEN low AND high AND NOT private)
"""
