"""Rollups from stored parts, and sessions, repeats and joins of streams, against plain loops."""

import random
from collections import defaultdict
from datetime import UTC, timedelta

from pyspark.sql import functions as F

from tests.test_ledger import at, landed, stream
from vouchlake.operators import rollups
from vouchlake.streaming import sessions
from vouchlake.streaming.sink import drained

UPLOADS = "upload bigint, email string, at timestamp"
RESULTS = "upload bigint, done timestamp"


def test_parts_of_batches_merge_and_stay_within_their_errors(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), r.choice(["m1", "m2"]), None if r.random() < 0.02 else f"p{r.randrange(6000)}", None if r.random() < 0.02 else r.randrange(10**6) / 100) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "status string, month string, party string, x double")
    dims = {"status": F.col("status"), "month": F.col("month")}
    for b in (0, 1, 2, 0, 2):  # two batches are written again
        own = spark.createDataFrame(rows[b::3], df.schema)
        rollups.stored(rollups.parts(own, dims, F.col("party"), F.col("x")), f"{tmp_path}/parts", str(b))
    got = {(x["level"], x["status"], x["month"]): x for x in rollups.cube(spark.read.parquet(f"{tmp_path}/parts"), ["status", "month"]).collect()}
    groups = defaultdict(list)
    for s, m, p, x in rows:
        for key in ((0, s, m), (1, s, None), (2, None, m), (3, None, None)):
            groups[key].append((p, x))
    assert set(got) == set(groups)
    for key, own in groups.items():
        amounts = sorted(x for _, x in own if x is not None)
        parties = len({p for p, _ in own if p is not None})
        assert got[key]["n"] == len(own) and abs(float(got[key]["total"]) - sum(amounts)) < 0.01 * len(own)
        assert abs(got[key]["distinct_about"] - parties) <= 0.08 * parties
        for q, name in ((0.5, "q50"), (0.9, "q90")):
            assert amounts[int((q - 0.03) * len(amounts))] <= got[key][name] <= amounts[min(len(amounts) - 1, int((q + 0.03) * len(amounts)))]


def test_groups_without_amounts_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None)], "status string, party string, x double")
    part = rollups.parts(df, {"status": F.col("status")}, F.col("party"), F.col("x"))
    got = rollups.cube(part, ["status"]).collect()
    assert all(x["n"] == 1 and x["total"] is None and x["distinct_about"] == 0 and x["q50"] is None for x in got)
    assert rollups.parts(df.limit(0), {"status": F.col("status")}, F.col("party"), F.col("x")).count() == 0


def test_sessions_without_repeats(spark, tmp_path):
    r = random.Random(2)
    rows = sorted(((i, r.choice(["hot"] * 4 + ["b", None]), at(r.randrange(400) * 300)) for i in range(300)), key=lambda x: x[2])
    cuts = [0, 100, 200, 300]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = rows[a:b] + rows[a : a + 20]  # twenty are sent twice
        r.shuffle(batch)
        landed(spark, f"{tmp_path}/in", str(k), batch, UPLOADS)
    once = drained(sessions.without_repeats(stream(spark, f"{tmp_path}/in", UPLOADS)), "once", f"{tmp_path}/once")
    assert sorted(x["upload"] for x in once.collect()) == list(range(300))
    got = drained(sessions.sessions(stream(spark, f"{tmp_path}/in", UPLOADS)), "sessions", f"{tmp_path}/sessions").collect()
    every = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in rows[a:b] + rows[a : a + 20]]
    mark = max(x[2] for x in rows) - timedelta(hours=1)
    want = []
    for user in {x[1] or "" for x in rows}:
        times = sorted(x[2] for x in every if (x[1] or "") == user)
        run = [times[0]]
        for t in [*times[1:], None]:
            if t is not None and t <= run[-1] + timedelta(minutes=30):
                run.append(t)
                continue
            if run[-1] + timedelta(minutes=30) <= mark:
                want.append((user, run[0], run[-1] + timedelta(minutes=30), len(run)))
            run = [t]
    assert sorted(((x["email"], x["started"].replace(tzinfo=UTC), x["ended"].replace(tzinfo=UTC), x["n"]) for x in got), key=str) == sorted(want, key=str)


def test_uploads_meet_their_results(spark, tmp_path):
    uploads = [(1, "a", at(0)), (2, "a", at(60)), (3, "b", at(120)), (4, "b", at(50_000))]
    results = [(1, at(30)), (2, at(60 + 601)), (9, at(10)), (4, at(50_000 + 600)), (0, at(60_000))]
    landed(spark, f"{tmp_path}/u", "0", uploads, UPLOADS)
    landed(spark, f"{tmp_path}/r", "0", results, RESULTS)
    got = drained(sessions.answered(stream(spark, f"{tmp_path}/u", UPLOADS), stream(spark, f"{tmp_path}/r", RESULTS)), "answered", f"{tmp_path}/state").collect()
    assert sorted((x["upload"], None if x["done"] is None else x["done"].replace(tzinfo=UTC)) for x in got) == [(1, at(30)), (2, None), (3, None), (4, at(50_600))]


def test_late_rows_have_a_table_of_their_own(spark):
    rows = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(9000)), (3, "a", None)], UPLOADS)
    seen = spark.createDataFrame([(0, "a", at(10_000)), (0, "a", None)], UPLOADS)
    in_time, behind = sessions.late(rows, "at", seen)
    assert sorted(x["upload"] for x in in_time.collect()) == [2, 3] and [x["upload"] for x in behind.collect()] == [1]
    assert sessions.late(rows, "at", seen.limit(0))[0].count() == 3
