"""Counters and keyed rows that several writers change, against plain dictionaries; laid-out tables by their plans."""

import os
import random
import threading
import uuid
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vouchlake.operators import store, upserts

COUNTS = "email string, usage_count bigint"


def counters(spark, folder):
    return upserts.Store(spark, str(folder), COUNTS, ["email"], add=["usage_count"], buckets=4)


def changes(r, n=200):
    return [(r.choice(["hot"] * 8 + [f"u{i}" for i in range(30)] + [None]), r.choice([1, 1, 2, None])) for _ in range(n)]


def summed(*batches):
    out = Counter()
    for b in batches:
        for email, n in b:
            out[email] += n or 0
    return dict(out)


def rows(s):
    got = s.read().collect()
    assert len({x["email"] for x in got}) == len(got)
    return {x["email"]: x["usage_count"] or 0 for x in got}


def test_two_writers_and_a_replay_give_the_same_table(spark, tmp_path):
    r, s = random.Random(1), counters(spark, tmp_path / "s")
    a, b, c, d = (changes(r) for _ in range(4))
    frame = lambda x: spark.createDataFrame(x, COUNTS)
    assert rows(s) == {} and s.compact() == 0
    s.write(frame(a), "one", 1)
    s.write(frame(b), "two", 1)
    s.write(frame(a), "one", 1)  # a replay
    assert rows(s) == summed(a, b)
    assert s.compact() == 1 and rows(s) == summed(a, b)
    s.write(frame(b), "two", 1)  # a replay of what is compacted
    s.write(frame(c), "one", 2)
    assert rows(s) == summed(a, b, c)
    assert s.compact() == 2 and s.compact() == 2 and rows(s) == summed(a, b, c)
    s.write(frame(d), "two", 2)
    assert rows(counters(spark, tmp_path / "s")) == summed(a, b, c, d)


def test_writers_at_once(spark, tmp_path):
    r, s = random.Random(2), counters(spark, tmp_path / "s")
    s.write(spark.createDataFrame([("hot", 1)], COUNTS), "first", 0)
    work = [(f"w{k}", i, changes(r, 40)) for k in range(2) for i in range(3)]

    def run(writer):
        for w, i, rows_ in work:
            if w == writer:
                counters(spark, tmp_path / "s").write(spark.createDataFrame(rows_, COUNTS), w, i)

    both = [threading.Thread(target=run, args=(f"w{k}",)) for k in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert rows(s) == summed([("hot", 1)], *[x for *_, x in work])


def test_a_compaction_that_dies_and_two_at_once(spark, tmp_path, monkeypatch):
    r, s = random.Random(3), counters(spark, tmp_path / "s")
    a, b = changes(r), changes(r)
    s.write(spark.createDataFrame(a, COUNTS), "one", 1)
    merged = s._merged
    monkeypatch.setattr(s, "_merged", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        s.compact()
    except RuntimeError:
        pass
    monkeypatch.setattr(s, "_merged", merged)
    assert rows(s) == summed(a)
    # Rows and batches of a version without manifest are not there.
    s.compact()
    version = s._version()
    s.write(spark.createDataFrame(b, COUNTS), "two", 1)
    s.compact()
    gone = f"{tmp_path}/s/manifest/version={version + 1}"
    for f in os.listdir(gone):
        os.remove(f"{gone}/{f}")
    os.rmdir(gone)
    assert s._version() == version and rows(s) == summed(a, b)
    assert s.compact() == version + 1 and rows(s) == summed(a, b)


def test_a_compaction_rewrites_only_changed_buckets(spark, tmp_path):
    s = counters(spark, tmp_path / "s")
    s.write(spark.createDataFrame([(f"u{i}", 1) for i in range(100)], COUNTS), "one", 1)
    s.compact()
    s.write(spark.createDataFrame([("u1", 1)], COUNTS), "one", 2)
    s.compact()
    of = {x["bucket"]: x["of"] for x in s._table("manifest", "bucket int, of string, version bigint").where("version = 2").collect()}
    assert len(of) == 4 and sorted(Counter(of.values()).values()) == [1, 3] and rows(s)["u1"] == 2


def test_latest_rows(spark, tmp_path):
    r = random.Random(4)
    s = upserts.Store(spark, str(tmp_path / "s"), "email string, at bigint, status string", ["email"], by="at", buckets=4)
    want, made = {}, [[(r.choice(["a", "b", None]), r.choice([None, *range(20)]), f"{w}{i}{k}") for k in range(15)] for w in "xy" for i in range(2)]
    for (w, i), batch in zip([(w, i) for w in "xy" for i in range(2)], made, strict=True):
        s.write(spark.createDataFrame(batch, "email string, at bigint, status string"), w, i)
        for email, at, status in batch:
            key = (-1 if at is None else at, w, i, status)
            want[email] = max(want.get(email, key), key)
        if i:
            s.compact()
    assert {x["email"]: x["status"] for x in s.read().collect()} == {k: v[3] for k, v in want.items()}


def test_laid_out_history_needs_no_shuffle_and_prunes(spark, tmp_path):
    h = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("id"), F.concat(F.lit("u"), F.col("id") % 500).alias("email"), F.timestamp_seconds(F.col("id") % 997).alias("created_at"))
    name = f"t{uuid.uuid4().hex}"
    history = upserts.laid_out(h, f"h{name}", ["email"], ["created_at"], 4, ("id",), f"{tmp_path}/h")
    usage = upserts.laid_out(store.user_counts(h), f"u{name}", ["email"], [], 4, (), f"{tmp_path}/u")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        each = store.latest_each(history, 3).join(usage, "email")
        assert each.count() == 1500
        plan = each._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" not in history.groupBy("email").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = store.by_id(history, 7919)
    assert "EqualTo(id,7919)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # has the plan show the pruned buckets
    mine = history.where("email = 'u7'")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in plan and mine.count() == 40  # a user's rows are in one bucket, sorted
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    parts = [pq.ParquetFile(f"{tmp_path}/h/{f}") for f in os.listdir(f"{tmp_path}/h") if f.endswith(".parquet")]
    assert all(p.read(columns=["email"]).column(0).to_pylist() == sorted(p.read(columns=["email"]).column(0).to_pylist()) for p in parts)
