"""Registered queries of state over time: quotas of streams and as of a time, expiry, nearest amounts, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, nearest, rollups, store, upserts
from ..sources.shared import new_folder
from ..streaming import expiry, quota, sessions
from ..streaming.sink import drained
from .queries import MONEY, orders, tab
from .registry import query


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The pattern has the file source take a single file too."""
    return spark.readStream.schema(tab(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("stream_quota", """
WITH r AS (
  SELECT concat('u', CAST(user_id AS varchar)) AS email, CAST(event_id AS varchar) AS request, ts, 1 + event_id % 3 AS size, user_id % 25 = 0 AS pro,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS varchar)) AS k FROM events),
users AS (SELECT email, list(size ORDER BY k) AS sizes FROM r GROUP BY email),
-- A request sees what the allowed ones before it have taken; a refused one takes nothing.
decided AS (
  SELECT email, request, ts, size, pro, CASE WHEN pro THEN 0 ELSE list_reduce(list_prepend(0, sizes[1:k - 1]), lambda a, x: CASE WHEN a + x <= 10 THEN a + x ELSE a END) END AS used
  FROM r JOIN users USING (email)),
said AS (SELECT *, pro OR used + size <= 10 AS allowed FROM decided)
SELECT email, request, size, CAST(used AS bigint) AS used, allowed, CAST(greatest(0, 10 - used - CASE WHEN allowed AND NOT pro THEN size ELSE 0 END) AS bigint) AS remaining, again AS repeated
FROM said, (SELECT unnest([false, true]) AS again) WHERE NOT again OR CAST(request AS bigint) % 5 = 0
""")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests of all events as a stream, of one to three files each; every fifth is sent twice."""
    e = arriving(spark, sf_dir, "events")
    sent = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)))
    requests = e.select(F.concat(F.lit(" U"), F.col("user_id").cast("string")).alias("email"), F.col("event_id").alias("request"), F.col("ts").alias("at"), (F.col("event_id") % 3 + 1).alias("size"), sent.alias("sent"))
    pro = tab(spark, sf_dir, "events").where("user_id % 25 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"))
    return quota.decided(requests, pro).select("email", "request", "size", "used", "allowed", "remaining", "repeated")


@query("stream_expiry", """
WITH w AS (SELECT DISTINCT concat('out/', CAST(user_id AS varchar), '/', event_type) AS path, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IS NOT NULL),
n AS (SELECT path, t, lead(t) OVER (PARTITION BY path ORDER BY t) AS again, max(t) OVER () AS latest FROM w)
SELECT path, t AS written_ms, t + 86400000 AS deleted_ms FROM n WHERE (again IS NULL OR again > t + 86400000) AND t + 86400000 <= latest - 3600000
""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of each user and kind, written at every event; deleted a day after the last write of a run of them."""
    e = arriving(spark, sf_dir, "events").where("event_type is not null")
    gone = expiry.deleted(e.select(F.concat_ws("/", F.lit("out"), F.col("user_id").cast("string"), "event_type").alias("path"), F.col("ts").alias("at")))
    return gone.select("path", F.unix_millis("written").alias("written_ms"), F.unix_millis("deleted").alias("deleted_ms"))


@query("quota_as_of", """
WITH u AS (SELECT user_id, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events WHERE event_type = 'purchase'),
r AS (SELECT * FROM events WHERE event_type IS DISTINCT FROM 'purchase'),
seen AS (SELECT r.event_id, coalesce(max(u.used), 0) AS used FROM r LEFT JOIN u ON r.user_id = u.user_id AND u.ts < r.ts GROUP BY r.event_id)
SELECT event_id, used, used < 10 AS single_allowed, used + event_id % 4 + 1 <= 10 AS bulk_allowed, greatest(0, 10 - used) AS remaining FROM seen
""")
def quota_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its user's uploads before it: purchases are the uploads, the other events the requests, of one to four files."""
    e = tab(spark, sf_dir, "events")
    uploads = asof.running_total(e.where("event_type = 'purchase'"), "user_id", "ts", F.lit(1), "used", ["event_id"])
    seen = asof.asof(e.where("not event_type <=> 'purchase'").select("event_id", "user_id", "ts"), uploads, "user_id", "ts", ["used"], ["event_id"])
    used = F.coalesce("used", F.lit(0).cast("bigint"))
    return seen.select("event_id", used.alias("used"), (used < 10).alias("single_allowed"), (used + F.col("event_id") % 4 + 1 <= 10).alias("bulk_allowed"), F.greatest(F.lit(0), 10 - used).alias("remaining"))


@query("usage_running", "SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::bigint AS used FROM events")
def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter of each user after every event."""
    return asof.running_total(tab(spark, sf_dir, "events"), "user_id", "ts", (F.col("event_type") == "purchase").cast("int"), "used", ["event_id"]).select("event_id", "used")


@query("nearest_ledger", """
WITH i AS (SELECT o_orderkey, CAST(o_totalprice AS decimal(18,2)) AS x FROM orders),
l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS decimal(18,2)) AS y FROM lineitem GROUP BY l_orderkey),
near AS (
  SELECT o_orderkey, l_orderkey, y - x AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(y - x), y - x, l_orderkey) AS k
  FROM i JOIN l ON y BETWEEN x - 1.5 AND x + 1.5)
SELECT i.o_orderkey AS doc_id, l_orderkey AS match, CAST(gap AS double) AS gap FROM i LEFT JOIN near ON i.o_orderkey = near.o_orderkey AND k = 1
""")
def nearest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each invoice's amount the ledger total nearest to it, within the tolerance."""
    lines, orders = tab(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), tab(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # Dealt by order before the sums: a task's table of sums is as large as its deal, not as its part of a file.
    ledger = lines.repartition(nearest.tasks_for(lines), "l_orderkey").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("total"))
    found = nearest.nearest(orders, ledger, F.col("o_totalprice"), F.col("total"), F.col("l_orderkey"), tasks=nearest.tasks_for(orders))
    return found.select(F.col("o_orderkey").alias("doc_id"), "match", F.col("gap").cast("double").alias("gap"))


@query("nearest_of_party", """
WITH i AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS decimal(18,2)) AS x FROM orders),
near AS (
  SELECT a.o_orderkey, b.o_orderkey AS other, b.x - a.x AS gap, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(b.x - a.x), b.x - a.x, b.o_orderkey) AS k
  FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND b.x BETWEEN a.x - 5000 AND a.x + 5000 AND a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1)
SELECT i.o_orderkey AS doc_id, other AS match, CAST(gap AS double) AS gap FROM i LEFT JOIN near ON i.o_orderkey = near.o_orderkey AND k = 1 WHERE i.o_orderkey % 2 = 0
""")
def nearest_of_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of one book (even numbers) against those of another (odd ones) of the same party, within 5,000."""
    o = tab(spark, sf_dir, "orders")
    found = nearest.nearest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), F.col("o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey"), 5000, (F.col("o_custkey"), F.col("o_custkey")))
    return found.select(F.col("o_orderkey").alias("doc_id"), "match", F.col("gap").cast("double").alias("gap"))


@query("usage_upserts", "SELECT CAST(user_id AS varchar) AS email, count(*) AS usage_count FROM events GROUP BY 1")
def usage_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every user after two writers, a replayed batch, a compaction and changes after it."""
    e = tab(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("email"), F.lit(1).cast("bigint").alias("usage_count"), (F.col("event_id") % 4).alias("part"))
    counters = upserts.Store(spark, new_folder(spark, "usage"), store.USERS, ["email"], add=["usage_count"], buckets=8)
    counters.write(e.where("part = 0"), "a", 1)
    counters.write(e.where("part = 1"), "b", 1)
    counters.write(e.where("part = 0"), "a", 1)
    counters.compact()
    counters.write(e.where("part = 2"), "a", 2)
    counters.write(e.where("part = 1"), "b", 1)
    counters.write(e.where("part = 3"), "b", 2)
    return counters.read()


@query("history_upserts", """
WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT CAST(o_custkey AS varchar) AS email, o_orderkey AS id, CAST(o_totalprice AS double) AS total_amount FROM c WHERE k = 1""")
def history_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last invoice, from batches that two writers write in any order, with a compaction between."""
    o = orders(spark, sf_dir).withColumn("at", F.struct("created_at", "id"))
    last = upserts.Store(spark, new_folder(spark, "history"), "email string, id bigint, total_amount double, at struct<created_at:timestamp,id:bigint>", ["email"], by="at", buckets=8)
    rows = o.select("email", F.col("id").cast("bigint").alias("id"), F.col("total_amount").cast("double").alias("total_amount"), F.struct(F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").cast("bigint").alias("id")).alias("at"))
    last.write(rows.where("id % 3 = 1"), "a", 1)
    last.write(rows.where("id % 3 = 0"), "b", 7)
    last.compact()
    last.write(rows.where("id % 3 = 2"), "b", 8)
    return last.read().select("email", "id", "total_amount")


@query("history_laid_out", """
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT CAST(o_custkey AS varchar) AS email, o_orderkey AS id, k AS rank, n AS usage_count FROM h WHERE k <= 10""")
def history_laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest rows of every user with the user's counter, from bucketed tables: no shuffle after they are written."""
    o = orders(spark, sf_dir)
    name = f"h{uuid.uuid4().hex}"
    history = upserts.laid_out(o, f"history_{name}", ["email"], ["created_at", "id"], 8, ("id",), new_folder(spark, "history"))
    usage = upserts.laid_out(store.user_counts(o).withColumnRenamed("n", "usage_count"), f"usage_{name}", ["email"], [], 8, (), new_folder(spark, "usage"))
    return store.latest_each(history).join(usage, "email").select("email", "id", F.col("rank").cast("bigint").alias("rank"), "usage_count")


@query("rollup_cube", """
WITH o AS (SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS month, o_custkey, CAST(o_totalprice AS decimal(18,2)) AS x FROM orders)
SELECT status, month, CAST(GROUPING_ID(status, month) AS bigint) AS level, count(*) AS n, CAST(sum(x) AS double) AS total, true AS distinct_within, true AS median_within
FROM o GROUP BY CUBE (status, month)""")
def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices by status and month from the stored parts of three batches, one of them written twice; estimates are held against exact values, within their stated errors."""
    o = tab(spark, sf_dir, "orders")
    dims = {"status": F.col("o_orderstatus"), "month": F.date_format("o_orderdate", "yyyy-MM")}
    folder = new_folder(spark, "rollup")
    for b in (0, 1, 2, 1):
        rollups.stored(rollups.parts(o.where(F.col("o_orderkey") % 3 == b), dims, F.col("o_custkey"), F.col("o_totalprice")), folder, f"b{b}")
    about = rollups.cube(spark.read.parquet(folder), list(dims), (0.5,))
    rows = o.select(*[c.alias(n) for n, c in dims.items()], "o_custkey", F.col("o_totalprice").cast("double").alias("x"))
    exact = rows.cube(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.countDistinct("o_custkey").alias("d"), F.percentile("x", F.array(F.lit(0.47), F.lit(0.53))).alias("p"))
    same = F.col("a.level").eqNullSafe(F.col("e.level"))
    for n in dims:
        same &= F.col(f"a.{n}").eqNullSafe(F.col(f"e.{n}"))
    met = about.alias("a").join(exact.alias("e"), same)
    # Five standard errors for the distinct values; for the median the ranks 0.47 to 0.53, or one place where a group is small.
    near = F.abs(F.col("distinct_about") - F.col("d")) <= F.greatest(F.lit(1.0), 0.08 * F.col("d"))
    slack = F.when(F.col("n") < 50, F.lit(float("inf"))).otherwise(0.0)
    return met.select("a.status", "a.month", "a.level", "n", F.col("total").cast("double").alias("total"), near.alias("distinct_within"), F.col("q50").between(F.col("p")[0] - slack, F.col("p")[1] + slack).alias("median_within"))


@query("stream_sessions", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, before) AS k FROM e),
g AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k)
SELECT CAST(user_id AS varchar) AS email, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, n FROM g WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions of events as a stream gives them out; those that the watermark has not passed are still open."""
    e = arriving(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("email"), F.col("ts").cast("timestamp").alias("at"))
    got = drained(sessions.sessions(e), "sessions")
    return got.select("email", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


@query("stream_answered", """
WITH u AS (SELECT event_id AS upload, ts AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS upload, ts + to_seconds(CAST(event_id % 1500 AS integer)) AS done FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0),
w AS (SELECT least((SELECT max(t) FROM u), (SELECT max(done) FROM r)) - INTERVAL 1 HOUR AS mark)
SELECT u.upload, epoch_us(t) AS at_us, epoch_us(done) AS done_us FROM u LEFT JOIN r ON u.upload = r.upload AND done >= t AND done <= t + INTERVAL 10 MINUTE
WHERE done IS NOT NULL OR t + INTERVAL 10 MINUTE < (SELECT mark FROM w)""")
def stream_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads met with their results within ten minutes, both as streams; every fourth upload is sent twice."""
    e = arriving(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    uploads = e.select(F.col("event_id").alias("upload"), F.col("ts").alias("at"), F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 4 == 0, 2).otherwise(1))).alias("sent")).drop("sent")
    again = arriving(spark, sf_dir, "events").where("event_type = 'purchase' and event_id % 7 <> 0")
    results = again.select(F.col("event_id").alias("upload"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1500 * 1_000_000).alias("done"))
    got = drained(sessions.answered(sessions.without_repeats(uploads), results, marked=True), "answered")
    return got.select("upload", F.unix_micros("at").alias("at_us"), F.unix_micros("done").alias("done_us"))
