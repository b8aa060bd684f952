"""Nearest matches of amounts between two tables, within a tolerance.

Amounts are cut into bins as wide as the tolerance, so that what is within reach of an amount lies in its own bin or in
a neighbouring one: an equality join in place of a cross join. Both sides are first reduced to their distinct amounts (and key), with the
first candidate of each, so a bin holds at most as many rows as it has amounts (tolerance / unit of money), whatever the
number of rows with one amount, and no bin is hot. The matches of distinct amounts go back to the rows in salted copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY

SALTS = 16
TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """A number of tasks that grows with the rows, at least the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def nearest(left: DataFrame, right: DataFrame, amount: Column, of: Column, name: Column, tolerance: float = 1.5, by: tuple[Column, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """left with match (name of the nearest row of right) and gap (how much larger that row's amount is); null where none is within the tolerance.

    amount and by[0] are of left; of, name and by[1] of right. Ends are within (a gap of exactly the tolerance). Of equally near
    amounts the smaller one wins, and of rows with one amount the least name. Null amounts and null keys match nothing. Rows of left keep their number.
    tasks: to how many tasks the rows of left are dealt before their amounts meet; what a task holds follows the input's files otherwise.
    """
    width = F.lit(tolerance).cast(MONEY)
    key_a, key_b = by or (F.lit(0), F.lit(0))
    columns = left.columns
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), amount.cast(MONEY).alias("__x"), key_a.alias("__k"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    if tasks:
        rows = rows.repartition(tasks, "__x", "__salt")
    asked = rows.where("__x is not null and __k is not null").select("__k", "__x").distinct().withColumn("__bin", F.floor(F.col("__x") / width))
    offered = right.select(key_b.alias("__k"), of.cast(MONEY).alias("__y"), name.alias("__name")).where("__y is not null and __k is not null").groupBy("__k", "__y").agg(F.min("__name").alias("__name"))
    near = offered.withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("__y") / width) + d)))
    gap = (F.col("__y") - F.col("__x")).cast(MONEY)
    within = asked.join(near, ["__k", "__bin"]).where(F.abs(gap) <= width)
    best = within.groupBy("__k", "__x").agg(F.min(F.struct(F.abs(gap).alias("d"), gap.alias("gap"), F.col("__name").alias("name"))).alias("__best"))
    copies = best.select(F.col("__k").alias("__kb"), F.col("__x").alias("__xb"), "__best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__sb"))
    joined = rows.join(copies, (F.col("__k") == F.col("__kb")) & (F.col("__x") == F.col("__xb")) & (F.col("__salt") == F.col("__sb")), "left")
    return joined.select("__row.*", F.col("__best.name").alias("match"), F.col("__best.gap").alias("gap"))
