"""As-of joins and running totals that split a hot key by time.

A key's rows are cut into slices of time, and (key, slice) is what is shuffled and sorted, so that a key with a third of
all rows is as many tasks as it has slices. What a slice inherits from those before it, the last value or the sum, is carried
over a table that has one row for each slice, in which even a hot key is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _slice(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000))


def running_total(rows: DataFrame, by: str, at: str, value: Column, name: str, ties: list[str], seconds: int = DAY) -> DataFrame:
    """rows with the sum of `value` over the key's rows up to each, itself included, in order of time and then of `ties`.

    Null times come first; null values add nothing; null keys are a key.
    """
    rows = rows.withColumn("__value", F.coalesce(value.cast("bigint"), F.lit(0))).withColumn("__slice", _slice(F.col(at), seconds))
    sums = rows.groupBy(by, "__slice").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(by).alias("__by"), F.col("__slice").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    own = Window.partitionBy(by, "__slice").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("__own", F.sum("__value").over(own))
    joined = within.join(carried, F.col(by).eqNullSafe(F.col("__by")) & F.col("__slice").eqNullSafe(F.col("__of")))
    return joined.withColumn(name, F.col("__own") + F.col("__carried")).drop("__value", "__slice", "__by", "__of", "__own", "__carried")


def asof(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], ties: list[str], strict: bool = True, seconds: int = DAY) -> DataFrame:
    """left with the values of the key's last row of right before its time; null where there is none.

    strict: before, not at, the time. Of right's rows at one time the last by `ties` counts. Both sides merge into one
    sorted stream; rows of left keep their number. A row of left without time has no values.
    """
    kind = {n: right.select(F.struct(*c).alias(n)).schema[n].dataType for n, c in (("value", values), ("tie", ties))}
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(row.alias("__row"), F.col(by).alias("__by"), F.col(at).cast("timestamp").alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(kind["value"]).alias("__value"), F.lit(None).cast(kind["tie"]).alias("__tie"))
    b = right.where(F.col(at).isNotNull()).select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(by).alias("__by"), F.col(at).cast("timestamp").alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.struct(*values).alias("__value"), F.struct(*ties).alias("__tie"))
    both = a.unionByName(b).withColumn("__slice", _slice(F.col("__at"), seconds))
    order = F.struct("__at", "__tie")
    lasts = both.groupBy("__by", "__slice").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), order)).alias("__last"))
    earlier = Window.partitionBy("__by").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("__by").alias("__key"), F.col("__slice").alias("__of"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    own = Window.partitionBy("__by", "__slice").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("__own", F.last("__value", ignorenulls=True).over(own)).where("__row is not null")
    joined = within.join(carried, F.col("__by").eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__of")))
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__carried"))
    return joined.select("__row", found.alias("__found")).select("__row.*", *[F.col("__found")[v].alias(v) for v in values])
