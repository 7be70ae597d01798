"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "ledgermill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has dots written as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_ledgermill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ledgermill-"), "ledgermill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(target)
    context._ledgermill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode and the warehouse elsewhere."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        set_one = context.getConf().get("spark.checkpoint.dir")
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        context.setCheckpointDir(set_one or (tempfile.mkdtemp(prefix="checkpoint-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder in the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, as a compressed table in the same shared folder; for wide or many rows."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is broadcast at most.
FEW_ROWS = 100_000


def is_few(df: DataFrame, few: int | None = None) -> bool:
    """Whether ``df``, which should be written already, has at most ``few`` rows, or FEW_ROWS."""
    few = FEW_ROWS if few is None else few
    return df.limit(few + 1).count() <= few


def broadcast_if_few(df: DataFrame, few: int | None = None) -> DataFrame:
    """``df``, which should be written already, to be broadcast in joins if it has few rows."""
    return F.broadcast(df) if is_few(df, few) else df
