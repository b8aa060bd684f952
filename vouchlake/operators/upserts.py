"""Counters and keyed rows on Parquet that several writers change, each change counted once.

A store is a folder with a change log and snapshots.

* Log: `log/writer=…/batch=…`. A writer's batch replaces itself (dynamic partition overwrite), so a replayed batch changes nothing, and two
  writers never write into one folder.
* Snapshots: rows in key-hashed buckets, `rows/version=…/bucket=…`; which version of each bucket is current, `manifest/version=…`; and
  the batches that are in it, `applied/version=…`. The manifest is written last, so a version without one is
  not there: a compaction that dies leaves the store as it was.

Reading joins the manifest's buckets with the log's batches that are not applied yet; Spark prunes the other buckets'
versions. Compaction rewrites only the buckets that have changes. Two compactions at once both start from the last version;
each has its own batches written down, and whichever version counts, what it lacks is still in the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


class Store:
    """Rows of one key with either a summed value (counters) or the latest row (upserts).

    keys: the key columns; add: columns that are summed over all changes; by: with `add` empty, the column whose greatest value says which
    change of a key is the latest (of equals, the one with the greatest writer and batch). Null keys are keys; null values add nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], add: list[str] | None = None, by: str | None = None, buckets: int = 64):
        self.spark, self.folder, self.keys, self.add, self.by, self.buckets = spark, folder.rstrip("/"), keys, add or [], by, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the store, empty where nothing was written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _ddl(self, *more: str) -> str:
        return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), *more])

    def write(self, changes: DataFrame, writer: str, batch: int) -> None:
        """Adds a batch of changes to the log; the same writer and batch again replaces it. Counters are added up before they are written."""
        rows = changes.select(*[f"`{c}`" for c in self.columns])
        if self.add:
            rows = rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.add])
        rows = rows.withColumn("bucket", self._bucket()).withColumn("writer", F.lit(writer)).withColumn("batch", F.lit(batch).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("writer", "batch").parquet(f"{self.folder}/log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _version(self) -> int | None:
        return self._table("manifest", "bucket int, of string, version bigint").agg(F.max("version")).first()[0]

    def _current(self) -> tuple[DataFrame, DataFrame, int]:
        """The snapshot's rows (with bucket), the log's rows that it lacks, and its version; 0 without one."""
        version = self._version() or 0
        manifest = self._table("manifest", "bucket int, of string, version bigint").where(F.col("version") == version).select("bucket", "of")
        rows = self._table("rows", self._ddl("writer string", "batch bigint", "of string", "bucket int")).join(F.broadcast(manifest), ["of", "bucket"], "left_semi")
        applied = self._table("applied", "writer string, batch bigint, version bigint").where(F.col("version") == version).select("writer", "batch")
        log = self._table("log", self._ddl("bucket int", "writer string", "batch bigint"))
        return rows, log.join(applied, ["writer", "batch"], "left_anti"), version

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key."""
        if self.add:
            return rows.groupBy("bucket", *self.keys).agg(*[F.sum(c).alias(c) for c in self.add], F.max("writer").alias("writer"), F.max("batch").alias("batch"))
        rest = [c for c in self.columns if c not in self.keys]
        last = F.max(F.struct(F.col(self.by).alias("__by"), "writer", "batch", *[F.col(f"`{c}`") for c in rest]))
        return rows.groupBy("bucket", *self.keys).agg(last.alias("__last")).select("bucket", *self.keys, *[F.col("__last")[c].alias(c) for c in [*rest, "writer", "batch"]])

    def read(self) -> DataFrame:
        """The store's rows as of now."""
        rows, log, _ = self._current()
        names = [*self.columns, "bucket", "writer", "batch"]
        return self._merged(rows.select(names).unionByName(log.select(names))).select(*[F.col(f"`{c}`") for c in self.columns])

    def compact(self) -> int:
        """Brings the log into a new version of the buckets that it changes. The version's number; the last one where there is nothing to do."""
        rows, log, version = self._current()
        batches = log.select("writer", "batch").distinct()
        if batches.isEmpty():
            return version
        of, new = uuid.uuid4().hex, version + 1
        folder = f"{self.folder}/applied/version={new}"
        # What is applied is fixed first: batches that arrive from here on stay in the log.
        old = self._table("applied", "writer string, batch bigint, version bigint").where(F.col("version") == version).select("writer", "batch")
        mine = f"{self.folder}/batches/{of}"
        batches.write.parquet(mine)
        taken = self.spark.read.parquet(mine)
        changes = log.join(taken, ["writer", "batch"], "left_semi")
        touched = changes.select("bucket").distinct()
        names = [*self.columns, "bucket", "writer", "batch"]
        kept = rows.join(touched, "bucket", "left_semi")
        merged = self._merged(kept.select(names).unionByName(changes.select(names))).withColumn("of", F.lit(of))
        merged.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("append").partitionBy("of", "bucket").parquet(f"{self.folder}/rows")
        current = self._table("manifest", "bucket int, of string, version bigint").where(F.col("version") == version)
        manifest = current.join(touched, "bucket", "left_anti").select("bucket", "of").unionByName(touched.select("bucket", F.lit(of).alias("of")))
        old.unionByName(taken).distinct().write.mode("overwrite").parquet(folder)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={new}")
        return new


def laid_out(rows: DataFrame, table: str, keys: list[str], order: list[str], buckets: int = 64, lookups: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """rows as a table in buckets of their keys, sorted within, with bloom filters on the columns that single rows are looked up by.

    Windows, aggregations and joins by the keys read it without a shuffle; a look-up reads the row groups that may hold its value.
    """
    out = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet")
    for c in lookups:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (out.option("path", path) if path else out).saveAsTable(table)
    return rows.sparkSession.table(table)
