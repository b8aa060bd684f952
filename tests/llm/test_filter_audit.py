"""The filter audit against a loop over documents and orders, and its SQL."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from tests.llm.data import awkward, documents, prose
from vouchlake.llm import filter_audit, queries

MARKS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, bad = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    docs = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in bad))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removals, every = [], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [d for d in own if not d[1] & set(order[:k])]
                gone = [d for d in left if f in d[1]]
                every[f] += len(gone)
                removals.append((part, "".join(order), k + 1, len(left) - len(gone), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*x, every[x[1][x[2] - 1]]) for x in removals]
    return sorted(out)


def made():
    r = random.Random(9)
    rows = awkward()
    for i in range(200):
        words = [r.choice(["Alpha", "beta", "GAMMA", "d$", "x", f"w{r.randrange(90)}"]) for _ in range(r.randrange(30, 90))]
        rows.append((1000 + i // 2, r.choice([" ".join(words), "\x1c".join(words), prose(60, i % 7)]), None, r.choice(["", None, "s0", "s1", "s2"]), 0, 0.0, [], 0, ""))
    labels = [(r[0], k % 3 % 2, k % 4 // 3) for k, r in enumerate(rows)] + [(1001, None, 1), (1001, 1, None), (None, 1, 1)]
    return rows, labels


def test_audit_matches_brute_force(spark):
    rows, labels = made()
    docs, marks = documents(spark, rows).repartition(3), spark.createDataFrame(labels, MARKS)
    got = filter_audit.audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(x) for x in got.collect())
    assert got == brute(rows, labels)
    shares = {(x[0], x[1][x[2] - 1]): x[9] for x in got}
    removed = {(x[0], x[1]): 0 for x in got}
    for x in got:
        removed[x[0], x[1]] += x[4]
    for part in {x[0] for x in got}:  # shares of the filters add up to what all of them remove, in every order
        assert sum(v for k, v in shares.items() if k[0] == part) == 120 * removed[part, "ABCDE"] == 120 * removed[part, "EDCBA"]


def test_audit_of_empty_tables(spark):
    assert filter_audit.audit(documents(spark, []), spark.createDataFrame([], MARKS)).collect() == []
    got = filter_audit.audit(documents(spark, awkward()[:1]), spark.createDataFrame([], MARKS)).collect()
    assert len(got) == 600 and all(x["kept"] + x["removed"] <= 1 and x["good_lost"] == 0 for x in got)


def test_sql_of_the_audit_on_awkward_rows(spark, tmp_path):
    rows, labels = made()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, MARKS)
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(filter_audit.audit(docs, marks).columns)} FROM ({queries.OP12_SQL})").fetchall()) == brute(rows, labels)
