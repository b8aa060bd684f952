"""Streams that run until their source is drained, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import new_folder


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drained(stream: DataFrame, name: str, checkpoint: str | None = None, empty_batches: bool = True) -> DataFrame:
    """The rows that a stream gives for all that its source has now.

    The file sink commits a micro-batch's files together, so a batch that runs again adds nothing twice. A checkpoint is the
    folder of an earlier call: state and offsets go on from there, and the table has that call's rows too.
    empty_batches: whether the watermark's last move has a batch of its own, in which timers fire. State with a
    processing-time lifetime always asks for another batch, and so a stream of it would never be drained.
    """
    spark = stream.sparkSession
    folder = checkpoint or new_folder(spark, name)
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, str(empty_batches).lower())
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)  # a query keeps the settings that it started with
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
