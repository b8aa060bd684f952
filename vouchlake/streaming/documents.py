"""Structured Streaming over arriving texts and usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import extract
from ..operators.reconcile import status


def arriving(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, arrived timestamp") -> DataFrame:
    """A stream of text rows from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def extracted(stream: DataFrame) -> DataFrame:
    """The stream's invoices with their status. Extraction has no shuffle, so a micro-batch is one stage."""
    return extract(stream).withColumn("status", status(F.col("invoice")))


def usage(stream: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Counters of each user and window; rows later than the watermark no longer count, and their state goes."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", every), "email").agg(F.count(F.lit(1)).alias("n"))
