"""Expiry of outputs in event time.

A file is deleted at the retention after a write, unless it was written again until then. A file's writes are sessions whose gap is the
retention: a session ends when the last write that renews it is due, and Spark's state holds a session's two ends alone. When the
watermark passes the end, every write that could renew the file has been seen; the deletion is given out and the session goes, so state
holds live files only. Deletions depend on the times of the writes alone, not on their order within the
watermark's delay nor on how they fall into micro-batches. A file that is written after its deletion lives again.

Spark drops writes whose own deletion is due before the watermark; `late_rows` finds those behind a watermark for a sweep (`store.expired`
over a listing is another). A write behind the watermark that is not yet due by it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quota import state_store
from .sink import drained

RETAINED = 86_400


def deletions(writes: DataFrame, seconds: int = RETAINED, late: str = "1 hour") -> DataFrame:
    """A stream of deletions (path, written, deleted) over a stream of writes(path, at). Rows without path or time are no writes. Times are whole milliseconds."""
    at = F.timestamp_millis(F.unix_millis(F.col("at").cast("timestamp")))
    rows = writes.where(F.col("path").isNotNull() & F.col("at").isNotNull()).select("path", at.alias("at"))
    runs = rows.withWatermark("at", late).groupBy("path", F.session_window("at", f"{seconds} seconds").alias("run")).agg(F.max("at").alias("written"))
    return runs.select("path", "written", F.col("run.end").alias("deleted"))


def deleted(writes: DataFrame, seconds: int = RETAINED, late: str = "1 hour", checkpoint: str | None = None) -> DataFrame:
    """All deletions that are due by what the stream's source has now, as a table."""
    state_store(writes.sparkSession)
    return drained(deletions(writes, seconds, late), "expiry", checkpoint)


def late_rows(writes: DataFrame, watermark: str) -> DataFrame:
    """The writes before a watermark (a timestamp): those that the stream drops if they arrive after it."""
    return writes.where(F.col("at").cast("timestamp") < F.to_timestamp(F.lit(watermark)))
