"""Rollups of invoices that are kept as mergeable parts: exact sums and counts, sketches of distinct values and quantiles.

A batch gives one row for each of its finest groups, with a HyperLogLog sketch of the distinct values and a KLL sketch of the amounts. Parts
of any batches are stored together; a cube merges them, so no batch is read twice and no value is kept. A batch that is
written again replaces its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY

LG_K = 12  # 2^12 registers: a relative standard error of about 0.8 * 2 / sqrt(2^12) = 1.6 %
KLL_K = 400  # ranks within about 0.7 % (one-sided, at 99 %)


def parts(rows: DataFrame, dims: dict[str, Column], distinct: Column, amount: Column) -> DataFrame:
    """One row for each group of the dims: n, n_amounts, total, distinct_sketch and amount_sketch. Null amounts and null distinct values are left out of sketches; null dims are a group."""
    amounts = amount.cast("double")
    return rows.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(amount).alias("n_amounts"),
        F.sum(amount.cast(MONEY)).cast("decimal(28,2)").alias("total"),
        F.hll_sketch_agg(distinct.cast("string"), LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(amounts, KLL_K).alias("amount_sketch"),
    )


def stored(part: DataFrame, folder: str, batch: str) -> None:
    """Adds a batch's parts to a folder; the same batch again replaces its own."""
    part.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def cube(part: DataFrame, dims: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Every combination of the dims: level (grouping_id: a bit for each dim that is summed over), n, total, distinct_about and the amounts at the quantiles; null where a group has no amount."""
    merged = part.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("n").alias("n"),
        F.sum("n_amounts").alias("n_amounts"),
        F.sum("total").cast("decimal(28,2)").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch", F.lit(False))).alias("distinct_about"),
        F.kll_merge_agg_double("amount_sketch").alias("__amounts"),
    )
    at = [F.when(F.col("n_amounts") > 0, F.kll_sketch_get_quantile_double("__amounts", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return merged.select(*dims, "level", "n", "total", "distinct_about", *at)
