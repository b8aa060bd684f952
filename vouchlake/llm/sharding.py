"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's place is its fractional rank within
its source, so that any stretch of the sorted order holds the sources in the proportions of the whole.
Cutting that order into equal stretches gives shards whose row counts are at most one apart and whose
mixture is the corpus mixture.

Both ranks (within a source, and over all rows) are counted in two steps: rows per bucket of the sort key,
whose running sums are a small table, then a row's place within its bucket. Buckets hold about
`bucket_rows` rows however large a source is, so no task sees a whole source or the whole table.

Only the id, source, size and checksum of a row are shuffled; the text stays in the scan. Rows that are equal in
all four are counted before the first shuffle and ranked as one, with their number as weight; they are dealt out again,
`bucket_rows` at a time, only when each has its fraction. So one row may be repeated without bound.

Defined results: a null source is a source of its own; a null text has size 8 and the checksum of no bytes;
null or repeated ids are rows like any other (ties are ordered by id, checksum and size); an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HEX = 16


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """rank (from 0, of its first copy) and n (copies with these keys) of each row, in the order of bucket, then order; a row counts `copies` times."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum("copies").alias("in_bucket"))
    run = Window.partitionBy(*keys).orderBy(bucket)
    sums = sums.select(
        *[F.col(k).alias(f"s_{k}") for k in keys],
        F.col(bucket).alias("s_bucket"),
        (F.sum("in_bucket").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(Window.partitionBy(*keys)).alias("n"),
    )
    place = F.sum("copies").over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col(bucket) == F.col("s_bucket")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.withColumn("place", place).join(sums, on).withColumn("rank", F.col("before") + F.col("place")).drop("s_bucket", "before", "place", *[f"s_{k}" for k in keys])


def stratified_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size").cast("binary"))
    rows = rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", h)
    rows = written(rows, "shard_rows")
    sums = rows.agg(F.sum("copies").alias("total"), F.max("copies").alias("most")).first()
    total, most = int(sums["total"] or 0), int(sums["most"] or 0)
    buckets = max(1, -(-total // bucket_rows))
    digits = min(6, max(1, len(f"{buckets - 1:x}")))
    # The first hex digits of the hash cut each source into equal buckets, in the order of the hash.
    rows = rows.withColumn("hash_bucket", F.substring("h", 1, digits))
    ranked = _ranked(rows, ["source"], "hash_bucket", ["h", "doc_id", "text_crc32", "size"])
    # Each source starts at an offset of its own, else all sources of one row would meet at one place.
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("source")).cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(HEX**7))
    if most > bucket_rows:  # a row of many copies is dealt to several tasks before it is multiplied
        ranked = ranked.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(bucket_rows).cast("long"))))
        ranked = ranked.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "first")
    else:
        ranked = ranked.withColumn("first", F.lit(0).cast("long"))
    ranked = ranked.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + bucket_rows, "copies") - 1)))
    ranked = ranked.withColumn("fraction", (F.col("rank") + F.col("copy") + start) / F.col("n")).withColumn("copies", F.lit(1).cast("long")).drop("rank", "n", "hash_bucket", "first", "copy")
    ranked = ranked.withColumn("fraction_bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long")).withColumn("all", F.lit(0))
    placed = _ranked(ranked, ["all"], "fraction_bucket", ["fraction", "source", "h", "doc_id", "text_crc32", "size"])
    placed = placed.withColumn("shard", F.expr(f"(rank * {n_shards}) div {max(total, 1)}"))
    first = F.expr(f"(shard * {max(total, 1)} + {n_shards - 1}) div {n_shards}")  # rows before this shard
    return placed.select(
        "doc_id",
        F.when(F.col("source") != "\0", F.col("source")).alias("source"),
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
    )
