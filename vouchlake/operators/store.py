"""History and usage tables: inserts, counters, quotas, latest rows, flags and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import email_key
from .reconcile import gst_total, quota_bulk, quota_single

USERS = "email string, usage_count bigint"
INVOICES = "id bigint, email string, created_at timestamp, invoice_no string, invoice_date string, total_amount double, gst_amount double, file_url string, status string"


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in (("users", USERS), ("invoices", INVOICES)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def history_rows(invoices: DataFrame, email: Column, file_url: Column, status: Column, at: Column | None = None) -> DataFrame:
    """Rows for the history from a DataFrame with an `invoice` struct. Ids are unique among them, and increase within a partition; `append_history` sets them above a table's own."""
    inv = F.col("invoice")
    return invoices.select(
        F.monotonically_increasing_id().alias("id"),
        email.alias("email"),
        (at if at is not None else F.current_timestamp()).alias("created_at"),
        inv["invoice_number"].alias("invoice_no"),
        inv["invoice_date"].alias("invoice_date"),
        inv["final_amount"].cast("double").alias("total_amount"),
        gst_total(inv["cgst_amount"], inv["sgst_amount"], inv["igst_amount"]).cast("double").alias("gst_amount"),
        file_url.alias("file_url"),
        status.alias("status"),
    )


def append_history(rows: DataFrame, table: str) -> None:
    """Appends history rows; their ids go on after the table's greatest, so that ids stay unique over appends by one writer."""
    most = rows.sparkSession.table(table).agg(F.max("id")).first()[0]
    if most is not None:
        rows = rows.withColumn("id", F.col("id") + F.lit(most + 1))
    rows.write.mode("append").format("parquet").saveAsTable(table)


def user_counts(rows: DataFrame, email: str = "email") -> DataFrame:
    return rows.groupBy(F.col(email).alias("email")).agg(F.count(F.lit(1)).alias("n"))


def incremented(usage: DataFrame, events: DataFrame) -> DataFrame:
    """usage(email, usage_count) after one increment for each event; absent users start at 0. Counts meet before the shuffle."""
    both = usage.select("email", "usage_count").unionByName(events.select("email", F.lit(1).cast("long").alias("usage_count")))
    return both.groupBy("email").agg(F.sum(F.coalesce("usage_count", F.lit(0))).alias("usage_count"))


def upload_counts(events: DataFrame) -> DataFrame:
    """Counts by normalized address."""
    return events.groupBy(email_key(F.col("email")).alias("email")).agg(F.count(F.lit(1)).alias("n"))


def usage_of(usage: DataFrame, email: str) -> DataFrame:
    """One row: the user's counter, 0 where absent."""
    return usage.where(F.col("email") == email).agg(F.coalesce(F.max("usage_count"), F.lit(0).cast("long")).alias("usage_count"))


def gate(requests: DataFrame, usage: DataFrame, pro: DataFrame, most: int = 10) -> DataFrame:
    """requests(email, batch) with both gates; pro(email) is a list of accounts without a limit."""
    r = requests.join(usage, "email", "left").join(pro.select("email", F.lit(True).alias("pro")).distinct(), "email", "left")
    is_pro, used = F.coalesce("pro", F.lit(False)), F.coalesce("usage_count", F.lit(0))
    return r.select("email", "batch", used.alias("used"), is_pro.alias("pro"), quota_single(used, is_pro, most).alias("single_allowed"), quota_bulk(used, F.col("batch"), most).alias("bulk"))


def members(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """rows whose key is in the list."""
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, email: str, limit: int = 10) -> DataFrame:
    """A user's newest rows, by second, then by id; limit is held between 1 and 25."""
    return rows.where(F.col("email") == email).orderBy(F.desc(F.date_trunc("second", "created_at")), F.desc("id")).limit(max(1, min(25, limit)))


def latest_each(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The newest rows of every user. Spark keeps a user's first `limit` rows in each task before the shuffle."""
    w = Window.partitionBy("email").orderBy(F.desc(F.date_trunc("second", "created_at")), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_ten(rows: DataFrame, n: int = 10) -> DataFrame:
    """rows with can_download_xml: whether a row is among its user's n oldest. The n are found first, and joined back."""
    w = Window.partitionBy("email").orderBy(F.date_trunc("second", "created_at"), "id")
    oldest = rows.select("email", "id", "created_at").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    flagged = rows.join(oldest.select("id", F.lit(True).alias("can_download_xml")).distinct(), "id", "left")
    return flagged.withColumn("can_download_xml", F.coalesce("can_download_xml", F.lit(False)))


def history(rows: DataFrame, email: str, limit: int = 10) -> DataFrame:
    """A user's newest rows with the flag of the oldest ten."""
    return latest(first_ten(rows.where(F.col("email") == email)), email, limit)


def by_id(rows: DataFrame, key: int | str) -> DataFrame:
    return rows.where(F.col("id") == F.lit(key).cast("bigint")).limit(1)


def expired(files: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Files (path, modificationTime) older than `seconds`."""
    return files.where(F.unix_timestamp(now) - F.unix_timestamp("modificationTime") > seconds)
