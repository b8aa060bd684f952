"""Uploads as sessions, without repeats, and met with their results: windows and joins of streams.

Rows later than the watermark leave the stream's state alone; `late` parts a batch's rows by the watermark of the batches
before, so that they have a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(uploads: DataFrame, key: str = "upload", late: str = "1 hour") -> DataFrame:
    """A stream with the first row of each key; a repeat within `late` of it is dropped, and its state goes with the watermark."""
    return uploads.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(uploads: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's runs of uploads (email, at) with no pause longer than the gap: email, started, ended (the last upload and the gap), n. A session is given out when the watermark passes its end. A null address is the empty one."""
    found = uploads.withWatermark("at", late).groupBy(F.coalesce("email", F.lit("")).alias("email"), F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("email", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def answered(uploads: DataFrame, results: DataFrame, within: str = "10 minutes", late: str = "1 hour", marked: bool = False) -> DataFrame:
    """Uploads (upload, at) with their results (upload, done) of at most `within` after: upload, at, done; done is null where none came in time, given out when none can come any more. marked: uploads has its watermark already, as after `without_repeats`."""
    a = (uploads if marked else uploads.withWatermark("at", late)).alias("a")
    b = results.select(F.col("upload").alias("of"), F.col("done")).withWatermark("done", late).alias("b")
    met = F.expr(f"a.upload = b.of AND b.done >= a.at AND b.done <= a.at + INTERVAL {within}")
    return a.join(b, met, "leftOuter").select("upload", "at", "done")


def late(rows: DataFrame, at: str, seen: DataFrame, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """rows in time and rows that are late, by the greatest time in seen(at) less the delay; a null time is in time."""
    most = seen.agg(F.max("at")).first()[0]
    behind = F.coalesce(F.col(at) < F.lit(most).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return rows.where(~behind), rows.where(behind)
