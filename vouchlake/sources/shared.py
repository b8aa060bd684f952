"""Tables in the folder that driver and executors share: where lineage ends and more than one reader reads what was computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "vouchlake.shared.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most `rows` rows where the session has Spark's default of 10,000, which contents of files make large in Python."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of our own in local mode; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get(OWN, "")
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vouchlake-")
        spark.conf.set(OWN, at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
