"""Readers of transaction files, feedback, weights and CIDR tables.

All raw readers give strings in the canonical fields, so that validation sees what the file
holds. JSON keeps whether a value was a number in a column ``_numeric`` (names of the fields that
were): a numeric timestamp is epoch seconds, the same digits in quotes are not. Whatever else a record
has travels in one VARIANT column ``extras``, an object, in all formats alike; it is null where there is nothing else.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..settings import CANONICAL_FIELDS
from .mmdb import read_mmdb

#: Keys that may wrap the records of a JSON object; the first one present holds them.
WRAPPERS = ("transactions", "records", "data")

RAW = T.StructType([T.StructField(f, T.StringType()) for f in CANONICAL_FIELDS])
FEEDBACK = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("timestamp", T.StringType())])
#: The file of a compacted batch that names the batches it stands for.
REPLACES = "_replaces"
#: How batches of the feedback log are written and read; nulls are told from empty notes.
BATCH_CSV = {"header": "true", "escape": '"', "nullValue": "\\N"}
CIDR = T.StructType([T.StructField("ip_start", T.LongType()), T.StructField("ip_end", T.LongType()), T.StructField("prefix", T.IntegerType()), T.StructField("country", T.StringType()), T.StructField("city", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("asn_org", T.StringType())])


def _texts(df: DataFrame, fields: dict[str, Column], others: dict[str, Column]) -> DataFrame:
    """The canonical ``fields``, of which none is known to be a number, and the ``others`` that are not null as extras."""
    text = F.to_json(F.struct(*[c.alias(name) for name, c in others.items()])) if others else F.lit("{}")
    return df.select(*[c.alias(name) for name, c in fields.items()], F.array().cast("array<string>").alias("_numeric"), F.when(text != "{}", F.parse_json(text)).alias("extras"))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every value a string, missing trailing fields null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    here = {c: _column(c) for c in df.columns}
    return _texts(df, {f: here.get(f, F.lit(None).cast("string")) for f in CANONICAL_FIELDS}, {c: x for c, x in here.items() if c not in CANONICAL_FIELDS})


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of records, or an object that wraps one under a known key. Lists are read in splits, objects whole."""
    pieces = json_pieces(spark, path)
    if pieces is not None:
        return _fields(list_items(pieces).select(F.explode(F.from_json("items", "array<variant>")).alias("r")))
    raw = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("v"))
    first = raw.select(F.schema_of_variant("v").alias("s")).first()
    shape = first.s if first else "ARRAY<VOID>"
    if shape.startswith("ARRAY"):
        records = raw.select(F.col("v").alias("r"))
    elif shape.startswith("OBJECT"):
        present = [w for w in WRAPPERS if raw.select(F.variant_get("v", f"$.{w}", "variant").isNotNull().alias("p")).first().p]
        if not present:
            raise ValueError(f"the JSON object has none of the keys {', '.join(WRAPPERS)}")
        records = raw.select(F.variant_get("v", f"$.{present[0]}", "variant").alias("r"))
        kind = records.select(F.schema_of_variant("r").alias("s")).first().s
        if not kind.startswith("ARRAY"):
            raise ValueError(f"the value under {present[0]} is not a list of records")
    else:
        raise ValueError("JSON must be a list of records, or an object that holds one")
    return _fields(records.select(F.explode(F.from_json(F.to_json("r"), "array<variant>")).alias("r")))


def _fields(rows: DataFrame) -> DataFrame:
    """rows(r), a variant for each record -> canonical fields, which of them were numbers, the record as text, and its other fields."""
    fields = {f: F.variant_get("r", f"$.{f}", "string").alias(f) for f in CANONICAL_FIELDS}
    kinds = [F.when(F.schema_of_variant(F.variant_get("r", f"$.{f}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|BOOLEAN)"), F.lit(f)) for f in CANONICAL_FIELDS]
    others = F.map_filter(F.try_variant_get("r", "$", "map<string,variant>"), lambda k, _: ~k.isin(*CANONICAL_FIELDS))
    extras = F.when(F.size(others) > 0, F.to_variant_object(others)).alias("extras")
    return rows.select(*fields.values(), F.array_compact(F.array(*kinds)).alias("_numeric"), F.to_json("r").alias("_record"), extras)


def json_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, block, pos, text): the files cut at every closing brace, in as many tasks as they have splits; None unless all hold lists."""
    cut = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))
    cut = materialize(cut)
    opening = F.substring(F.regexp_replace("text", "^[\ufeff\\s]+", ""), 1, 1)
    odd = cut.where("block = 0").groupBy("file").agg(F.min_by(opening, "pos").alias("c")).where("c <> '['")
    return cut if odd.isEmpty() else None


def _before(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over all earlier pieces of their file: sums of splits first, then one window for each split."""
    place = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("file", "block").agg(F.sum(value).alias("own")).select("file", "block", F.coalesce(F.sum("own").over(place), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    running = pieces.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return running.join(sums, ["file", "block"]).withColumn(name, F.col(name) + F.col("ahead")).drop("ahead")


def list_items(pieces: DataFrame) -> DataFrame:
    """pieces of JSON lists -> (items): text of lists that together hold all items, each item whole.

    Whether a piece begins inside a string follows from the number of quotes before it, its depth then from the
    brackets outside strings, and a record ends where a brace closes at the depth of the list. A closing brace is
    never escaped, so that no escape is cut.
    """
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quoted = pieces.withColumn("quotes", F.size(F.split(bare, '"', -1)) - 1)
    quoted = _before(quoted, "quotes", "quotes_before")
    outside = F.array_join(F.filter(F.split(bare, '"', -1), lambda part, k: (k + F.col("quotes_before")) % 2 == 0), " ")
    ends_outside = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    closes = F.regexp_count(outside, F.lit(r"\]")) + ends_outside.cast("int")
    nested = quoted.withColumn("closed", ends_outside).withColumn("delta", F.regexp_count(outside, F.lit(r"[\[{]")) - closes)
    nested = materialize(nested.drop("quotes", "quotes_before"))
    nested = _before(nested, "delta", "depth")
    ended = nested.withColumn("border", (F.col("closed") & (F.col("depth") + F.col("delta") == 1)).cast("int")).drop("depth", "delta", "closed")
    placed = _before(materialize(ended), "border", "record")
    whole = placed.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "text"))).alias("parts"), F.max("border").alias("full"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "}")
    body = F.regexp_replace(text, "^[\ufeff\\s]*[\\[,]", "")
    body = F.when(F.col("full") == 1, F.concat(body, F.lit("}"))).otherwise(F.regexp_replace(body, r"\][\s}]*$", ""))
    return whole.select(F.concat(F.lit("["), body, F.lit("]")).alias("items"))


def read_xml(spark: SparkSession, path: str, record_tag: str = "transaction") -> DataFrame:
    """XML records at any depth; attributes win over children, of which blank ones are missing.

    A first pass finds which fields there are, all of them text, so that others than the canonical ones come along.
    """
    options = spark.read.format("xml").option("rowTag", record_tag).option("attributePrefix", "_").option("inferSchema", False)
    seen = options.load(path).schema
    both = {f.name: f for f in seen} | {p + f: T.StructField(p + f, T.StringType()) for f in CANONICAL_FIELDS for p in ("", "_")}
    df = options.schema(T.StructType(list(both.values()))).load(path)
    child = lambda f: F.when(F.trim(F.col(f)) != "", F.trim(F.col(f)))
    fields = {f: F.coalesce(F.col(f"_{f}"), child(f)) for f in CANONICAL_FIELDS}
    others: dict[str, Column] = {}
    for name in both:
        bare = name.removeprefix("_")
        if bare not in CANONICAL_FIELDS and not (name == bare and f"_{bare}" in both):
            others[bare] = _column(name)
            if name != bare and bare in both:  # an attribute and a child of one name
                plain = isinstance(both[bare].dataType, T.StringType)
                others[bare] = F.coalesce(_column(name), _column(bare) if plain else F.to_json(_column(bare)))
    return _texts(df, fields, others)


READERS = {".csv": read_csv, ".json": read_json, ".xml": read_xml}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the suffix, whatever its case."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix!r}; known are {', '.join(sorted(READERS))}")
    return READERS[suffix](spark, path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union by name of files in any of the formats; no paths give an empty table."""
    if not paths:
        return _texts(spark.createDataFrame([], RAW), {f: F.col(f) for f in CANONICAL_FIELDS}, {})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_any(spark, p) for p in paths])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whichever store its scheme names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def feedback_batches(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(live, replaced): names in the log's folder that count, and finished batches that a compaction has taken up.

    Names are listed in the driver, a few for each append since the last compaction.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in store.listStatus(folder))
    batches = [n for n in names if n.startswith("batch=") and store.exists(hadoop.Path(folder, f"{n}/_SUCCESS"))]
    lists = [f"{path}/{n}/{REPLACES}" for n in batches if store.exists(hadoop.Path(folder, f"{n}/{REPLACES}"))]
    gone = {line for text in lists for line in _read_text(spark, text).split()}
    loose = [n for n in names if not n.startswith(("batch=", "_", "."))]  # files of a log that was not written in batches
    return [n for n in loose + batches if n not in gone], [n for n in loose + batches if n in gone]


def _read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_feedback(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The feedback log in its fixed columns and ``seq``, the order of appends; an absent log is empty, absent columns are null.

    ``path`` is a folder of batches, or a CSV file. ``names`` are the entries of the folder to read, by default those that count.
    """
    fields = [*FEEDBACK, T.StructField("seq", T.LongType())]
    empty = spark.createDataFrame([], T.StructType(fields))
    if not path_exists(spark, path):
        return empty
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        paths = [f"{path}/{n}" for n in (feedback_batches(spark, path)[0] if names is None else names)]
    else:
        paths = [path]
    one = lambda df: df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    read = lambda part: one(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(part))
    batches, loose = [p for p in paths if "/batch=" in p], [p for p in paths if "/batch=" not in p]
    # Batches have one layout, files from elsewhere may have each their own.
    layout = "entity_id string, label string, note string, timestamp string, seq string"
    parts = [one(spark.read.schema(layout).options(**BATCH_CSV).option("multiLine", True).csv(batches))] if batches else []
    return reduce(lambda a, b: a.unionByName(b), [*parts, *map(read, loose)], empty)


def read_weights(spark: SparkSession, path: str) -> dict[str, float] | None:
    """Learned fusion weights, or None if there are none."""
    if not path_exists(spark, path):
        return None
    row = spark.read.schema("weights map<string,double>, bias double, n_feedback_examples long").option("multiLine", True).json(path).first()
    return dict(row.weights) if row and row.weights else None


def read_cidr(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A CIDR table in Parquet or CSV, the networks of an .mmdb file, or None: enrichment then gives nulls."""
    if not path or not path_exists(spark, path):
        return None
    if path.lower().endswith(".mmdb"):
        return read_mmdb(spark, path)
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).schema(CIDR).csv(path)
    return spark.read.parquet(path)
