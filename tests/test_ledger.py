"""State over time: quotas decided by a stream, expiry by timers, as-of counters and nearest amounts, against plain loops."""

import os
import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vouchlake.operators import asof, nearest
from vouchlake.streaming import expiry, quota

START = datetime(2024, 5, 1, tzinfo=UTC)
REQUESTS = "email string, request string, at timestamp, size bigint"
WRITES = "path string, at timestamp"


def landed(spark, folder, name, rows, schema):
    """One file of rows in a folder, whose modification time says its place among the others."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.startswith("part-"))
    to = f"{folder}/{name}.parquet"
    os.rename(f"{folder}-{name}/{part}", to)
    os.utime(to, (1_700_000_000 + 60 * int(name), 1_700_000_000 + 60 * int(name)))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def at(seconds):
    return START + timedelta(seconds=seconds)


# ------------------------------------------------------------------------------ quotas


def loop(batches, pro, most=10):
    used, said, out = {}, {}, []
    for rows in batches:
        for email, request, when, size in sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1] or "")):
            email, size = (email or "").strip().lower(), 1 if size is None else size
            again = request is not None and (email, request) in said
            if not again:
                was = 0 if email in pro else used.get(email, 0)
                allowed = email in pro or was + size <= most
                if allowed and email not in pro:
                    used[email] = was + size
                left = max(0, most - (used.get(email, 0) if allowed else was))
                got = (was, allowed, left)
                if request is not None:
                    said[email, request] = got
            out.append((email, request, size, *(said[email, request] if again else got), again))
    return sorted(out, key=str)


def batches():
    r = random.Random(4)
    made = []
    for b in range(3):
        rows = [(r.choice(["Hot@x.com", " hot@X.com "] * 4 + ["a@x", "pro@x", "", None]), f"r{b}-{i}", at(r.randrange(10_000)), r.choice([1, 1, 2, 4, 12, None])) for i in range(60)]
        rows += [rows[0], rows[1]]  # sent twice in one batch
        if made:
            rows += made[0][:5]  # and again in a later one
        rows += [("late@x", f"late{b}", at(-10**6), 1), ("n@x", None, at(5), 1), ("n@x", None, at(5), 1), ("n@x", f"null time {b}", None, 1)]
        made.append(rows)
    return made


def decisions(df):
    return sorted(((x["email"], x["request"], x["size"], x["used"], x["allowed"], x["remaining"], x["repeated"]) for x in df.collect()), key=str)


def test_quota_is_decided_at_each_arrival(spark, tmp_path):
    made, folder, keep = batches(), tmp_path / "in", f"{tmp_path}/state"
    pro = spark.createDataFrame([("PRO@x ",)], "email string")
    for i in (0, 1):
        landed(spark, str(folder), str(i), made[i], REQUESTS)
    first = decisions(quota.decided(stream(spark, folder, REQUESTS), pro, checkpoint=keep))
    assert first == loop(made[:2], {"pro@x"})
    # A later call goes on from the state; what is there is not decided again.
    landed(spark, str(folder), "2", made[2], REQUESTS)
    every = decisions(quota.decided(stream(spark, folder, REQUESTS), pro, checkpoint=keep))
    assert every == loop(made, {"pro@x"})
    assert any(x[6] for x in every) and any(not x[4] for x in every)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    made, folder, keep = batches(), tmp_path / "in", f"{tmp_path}/state"
    pro = spark.createDataFrame([], "email string")
    for i in (0, 1):
        landed(spark, str(folder), str(i), made[i], REQUESTS)
    before = decisions(quota.decided(stream(spark, folder, REQUESTS), pro, checkpoint=keep))
    last = max((f for f in os.listdir(f"{keep}/checkpoint/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):  # as if the driver had been lost before the last commit
        if os.path.exists(f"{keep}/checkpoint/commits/{f}"):
            os.remove(f"{keep}/checkpoint/commits/{f}")
    landed(spark, str(folder), "2", made[2], REQUESTS)
    after = decisions(quota.decided(stream(spark, folder, REQUESTS), pro, checkpoint=keep))
    assert before == loop(made[:2], set()) and after == loop(made, set())


def test_a_user_costs_few_calls_to_the_state_store():
    calls = []
    value, rows = [], []

    class Value:
        def get(self):
            calls.append("get")
            return value[-1] if value else None

        def update(self, v):
            calls.append("update")
            value.append(v)

    class Rows:
        def get(self):
            calls.append("list")
            return iter(list(rows))

        def appendList(self, more):
            calls.append("append")
            rows.extend(more)

    class Handle:
        def getValueState(self, *_, **__):
            return Value()

        def getListState(self, *_, **__):
            return Rows()

    gate = quota.Gate(most=10)
    gate.init(Handle())
    sent = [Row(request=str(i), at=at(i), size=1, pro=False) for i in range(5000)]
    first = list(gate.handleInputRows(("u",), iter(sent), None))
    assert calls == ["get", "append", "update"] and len(rows) == 5 and sum(x["allowed"] for x in first) == 10
    again = list(gate.handleInputRows(("u",), iter([*sent[::1000], Row(request=None, at=at(9), size=1, pro=False), Row(request="new", at=at(9), size=0, pro=False)]), None))
    assert calls[3:] == ["get", "list", "append"] and len(rows) == 6
    was = {x["request"]: (x["used"], x["allowed"], x["remaining"]) for x in first}
    assert [(x["request"], (x["used"], x["allowed"], x["remaining"])) for x in again if x["repeated"]] == [(n, was[n]) for n in ("0", "1000", "2000", "3000", "4000")]


# ------------------------------------------------------------------------------ expiry


def gone(writes, seconds, watermark):
    out = []
    for path in {p for p, w in writes if p is not None and w is not None}:
        times = sorted({w for p, w in writes if p == path and w is not None})
        for a, b in zip(times, [*times[1:], None], strict=True):
            due = a + timedelta(seconds=seconds)
            if (b is None or b > due) and due <= watermark:
                out.append((path, a, due))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2])
def test_deletions_do_not_depend_on_batches(spark, tmp_path, order):
    r = random.Random(order)
    writes = [(r.choice(["hot"] * 6 + ["b", "c", None]), at(60 * r.randrange(600)) if r.random() > 0.05 else None) for _ in range(200)] + [("once", at(0)), ("edge", at(0)), ("edge", at(1000))]
    writes.sort(key=lambda w: (w[1] or START) + timedelta(seconds=r.randrange(3000)))  # out of order, within the delay
    cuts = [0, *sorted(r.sample(range(1, len(writes)), 4)), len(writes)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        landed(spark, f"{tmp_path}/in", str(i), writes[a:b], WRITES)
    got = expiry.deleted(stream(spark, f"{tmp_path}/in", WRITES), seconds=1000, late="1 hour").collect()
    latest = max(w for _, w in writes if w)
    assert sorted((x["path"], x["written"].replace(tzinfo=UTC), x["deleted"].replace(tzinfo=UTC)) for x in got) == gone(writes, 1000, latest - timedelta(hours=1))


def test_late_writes_and_a_file_that_lives_again(spark, tmp_path):
    landed(spark, f"{tmp_path}/in", "0", [("a", at(0)), ("z", at(50_000))], WRITES)
    landed(spark, f"{tmp_path}/in", "1", [("late", at(10)), ("a", at(49_990)), ("z", at(90_000))], WRITES)
    landed(spark, f"{tmp_path}/in", "2", [("dropped", at(20)), ("b", at(90_001))], WRITES)
    got = expiry.deleted(stream(spark, f"{tmp_path}/in", WRITES), seconds=1000, late="1 minute").collect()
    assert sorted((x["path"], x["deleted"].replace(tzinfo=UTC)) for x in got) == [("a", at(1000)), ("a", at(50_990)), ("late", at(1010)), ("z", at(51_000))]
    rows = spark.createDataFrame([("late", at(10)), ("a", at(49_990))], WRITES)
    assert [x["path"] for x in expiry.late_rows(rows, "2024-05-01 10:00:00").collect()] == ["late"]


def test_a_late_write_that_is_not_due_counts_without_python(spark, tmp_path):
    landed(spark, f"{tmp_path}/in", "0", [("a", at(0)), ("z", at(5000))], WRITES)
    landed(spark, f"{tmp_path}/in", "1", [("b", at(4500)), ("z", at(20_000))], WRITES)  # behind the watermark (4940), due after it
    writes = stream(spark, f"{tmp_path}/in", WRITES)
    assert "TransformWithState" not in expiry.deletions(writes, 1000)._jdf.queryExecution().analyzed().toString()
    got = expiry.deleted(writes, seconds=1000, late="1 minute").collect()
    assert sorted((x["path"], x["deleted"].replace(tzinfo=UTC)) for x in got) == [("a", at(1000)), ("b", at(5500)), ("z", at(6000))]


# ------------------------------------------------------------------------------ as of a time


def test_running_totals_and_as_of_values_of_a_hot_user(spark):
    r = random.Random(7)
    user = lambda: r.choice(["hot"] * 5 + ["b", None])
    when = lambda: at(r.randrange(40) * 4000) if r.random() > 0.03 else None  # noqa: E731  many ties, several days
    rights = [(user(), when(), i, r.choice([1, 2, None])) for i in range(150)]
    lefts = [(user(), when(), i, "x") for i in range(150)] + [("nobody", at(3), 900, "x")]
    right = spark.createDataFrame(rights, "who string, at timestamp, n long, v long")
    left = spark.createDataFrame(lefts, "who string, at timestamp, id long, v string")  # v clashes with right's
    first = lambda t: (t is not None, t or START)
    total = {}
    for who, t, n, _ in rights:
        total[n] = sum(v or 0 for w, s, m, v in rights if w == who and (*first(s), m) <= (*first(t), n))
    summed = asof.running_total(right, "who", "at", F.col("v"), "sum", ["n"])
    assert {x["n"]: x["sum"] for x in summed.collect()} == total and summed.columns == [*right.columns, "sum"]
    for strict in (True, False):
        want = {}
        for who, t, i, _ in lefts:
            found = [(s, m) for w, s, m, _ in rights if w == who and t is not None and s is not None and (s < t or (not strict and s == t))]
            want[i] = total[max(found)[1]] if found else None
        got = asof.asof(left, summed, "who", "at", ["sum"], ["n"], strict).collect()
        assert len(got) == len(lefts) and {x["id"]: x["sum"] for x in got} == want
    plan = asof.asof(left, summed, "who", "at", ["sum"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


# ------------------------------------------------------------------------------ nearest amounts


def test_nearest_amounts_within_a_tolerance(spark):
    r = random.Random(8)
    money = lambda: None if r.random() < 0.03 else Decimal(r.choice([-150, 0, 0, 0, 149, 150, 151, 300, r.randrange(-900, 900)])) / 100
    lefts = [(i, money(), r.choice(["p", "q", None])) for i in range(300)] * 2
    rights = [(1000 + i, money(), r.choice(["p", "q", None])) for i in range(60)]
    left = spark.createDataFrame(lefts, "id long, x decimal(18,2), party string").withColumn("match", F.lit(1))
    right = spark.createDataFrame(rights, "name long, y decimal(18,2), party string")
    for by in (None, (F.col("party"), F.col("party"))):
        want = []
        for i, x, p in lefts:
            near = [(abs(y - x), y - x, n) for n, y, q in rights if x is not None and y is not None and abs(y - x) <= Decimal("1.5") and (by is None or (p == q and p is not None))]
            want.append((i, min(near)[2] if near else None, min(near)[1] if near else None))
        got = nearest.nearest(left.drop("match"), right, F.col("x"), F.col("y"), F.col("name"), 1.5, by)
        assert sorted(((x["id"], x["match"], x["gap"]) for x in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_one_hot_amount_makes_no_hot_bin(spark):
    left = spark.range(5000).select("id", F.lit("0.00").cast("decimal(18,2)").alias("x"))
    right = spark.range(5000).select(F.col("id").alias("name"), F.lit("0.50").cast("decimal(18,2)").alias("y"))
    got = nearest.nearest(left, right, F.col("x"), F.col("y"), F.col("name"))
    assert got.count() == 5000 and got.where("match = 0 and gap = 0.5").count() == 5000


def test_nearest_amounts_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TASK_ROWS", 100)
    left = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("x"))
    right = spark.range(50).select(F.col("id").alias("n"), (F.col("id") * 2.5).alias("y"))
    assert nearest.tasks_for(left) == 20 and nearest.tasks_for(right) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = nearest.nearest(left, right, F.col("x"), F.col("y"), F.col("n"), tasks=20)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, nearest.nearest(left, right, F.col("x"), F.col("y"), F.col("n")).collect()), key=str)
