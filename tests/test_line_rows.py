"""Lines as rows against the array forms of the same look-ups, with frames that cross chunks, and files read in several splits."""

import random

import pytest
from pyspark.sql import functions as F

from vouchlake.functions import amounts as A
from vouchlake.functions.text import normalize
from vouchlake.operators import extraction as X
from vouchlake.operators import line_rows as R

LABELS = ["SUB TOTAL", "TAXABLE VALUE"]
PATTERN = r"9\s*%\s*CGST"


def text(seed, n):
    r = random.Random(seed)
    kinds = ["ITEM {} {}", "HSN {} 12 NOS {}", "SUB TOTAL", "TAXABLE VALUE {}", "GRAND TOTAL {}", "9% CGST", "CGST {} {}", "SGST TOTAL {}", "DESCRIPTION TAX AMOUNT {}", "", "  ", "plain words", "HSN/SAC TAXABLE VALUE CGST AMOUNT", "8471 {} 9 % {}", "TOTAL {} {} {}", "PIN 600001 CHENNAI {}"]
    return "\n".join(r.choice(kinds).format(*[r.choice(["12", "1,234.50", f"{r.randrange(10**5)}.{r.randrange(100):02d}"]) for _ in range(3)]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", text(i, n)) for i, n in enumerate([1, 2, 3, 5, 8, 30, 60, 200, 400])] + [("empty", ""), ("null", None), ("hot", text(99, 5000))]
    return spark.createDataFrame(rows, "doc string, text string").repartition(3).cache()


@pytest.mark.parametrize("chunk", [4, 7, 4096])
def test_fields_are_those_of_the_array_form(spark, docs, chunk):
    lines = R.of_documents(docs, "doc")
    d = docs.select("doc", normalize(F.coalesce("text", F.lit(""))).alias("t")).select("doc", F.expr(A.analyzed("t")).alias("L"))
    want = d.select("doc", F.expr(A.labelled("L", LABELS)).alias("taxable"), F.expr(A.column_tax("L", "CGST")).alias("col"), F.expr(A.near_label_tax("L", PATTERN)).alias("near")).collect()
    got = R.fields(lines, "doc", chunk, taxable=R.labelled(LABELS), col=R.column_tax("CGST"), near=R.near_label_tax(PATTERN)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(x["near"] is not None for x in want) > 3
    targets = d.select("doc", F.lit(5000).cast(A.MONEY).alias("target"))
    want = d.select("doc", F.expr(A.near_totals("L", "CAST(5000 AS decimal(18,2))")).alias("near")).collect()
    assert sorted(map(tuple, R.near_totals(lines, targets, "doc", "target", chunk).collect())) == sorted(map(tuple, want))


def test_sums_totals_and_tables_are_those_of_the_array_form(spark, docs):
    lines = R.of_documents(docs, "doc")
    d = docs.select("doc", normalize(F.coalesce("text", F.lit(""))).alias("t")).select("doc", F.expr(A.analyzed("t")).alias("L"))
    want = d.select("doc", F.expr(A.tax_sum("L", "CGST")).alias("c"), F.expr(A.tax_sum("L", "SGST")).alias("s")).collect()
    assert sorted(map(tuple, R.tax_sums(lines, "doc", "CGST", "SGST").collect())) == sorted(map(tuple, want))
    targets = d.select("doc", F.lit(900).cast(A.MONEY).alias("least"))
    want = d.select("doc", F.expr(A.search_down("L", "CAST(900 AS decimal(18,2))")).alias("v")).collect()
    assert sorted(map(tuple, R.search_down(lines, targets, "doc", "least").collect())) == sorted(map(tuple, want))
    want = [x for x in d.select("doc", F.expr(X.tax_summary("L")).alias("s")).collect() if x["s"] is not None and any(v is not None for v in x["s"])]
    got = [x for x in R.tax_tables(lines, "doc").collect() if x["s"] is not None and any(v is not None for v in x["s"])]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 3


def test_a_file_of_many_splits(spark, tmp_path):
    t = "\n".join(text(k, 2000) for k in range(8))
    (tmp_path / "big.txt").write_text(t)
    (tmp_path / "small.txt").write_text("TAXABLE VALUE 5\n\nSUB TOTAL\r\n12.50")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = R.of_files(spark, str(tmp_path))
        rows = sorted((x["file"].rsplit("/", 1)[1], x["n"], x["line"]) for x in lines.collect())
        plan = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        found = {x["file"].rsplit("/", 1)[1]: x["v"] for x in R.fields(lines, "file", 64, v=R.labelled(LABELS)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert plan > 5
    own = spark.createDataFrame([("big.txt", t)], "f string, t string").select("f", F.split(normalize(F.col("t")), "\n").alias("l"))
    big = [x for x in rows if x[0] == "big.txt"]
    want = own.first()["l"]
    strip = [x[2] for x in big]
    assert [x[1] for x in big] == list(range(len(big))) and [x.strip() for x in strip if x.strip()] == [x.strip() for x in want if x.strip()]
    assert [x[1:] for x in rows if x[0] == "small.txt"] == [(0, "TAXABLE VALUE 5"), (1, "SUB TOTAL"), (2, "12.50")] and str(found["small.txt"]) == "5.00"


def test_a_document_of_very_many_lines_is_many_tasks(spark):
    n = 300_000
    lines = spark.range(n).select(F.lit("one").alias("doc"), F.col("id").alias("n"), F.when(F.col("id") == n - 2, "SUB TOTAL").when(F.col("id") == n - 1, "77.50").otherwise(F.concat(F.lit("ITEM "), F.col("id") % 97, F.lit(".25"))).alias("line"))
    f = R.framed(lines, "doc")
    spread = [x["count"] for x in f.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(spread) == n and max(spread) < n / 2
    got = R.fields(lines, "doc", v=R.labelled(LABELS)).collect()
    assert [(x["doc"], str(x["v"])) for x in got] == [("one", "77.50")]
    plan = R.fields(lines, "doc", v=R.labelled(LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan


@pytest.mark.parametrize("chunk", [4, 7])
def test_expected_totals_are_those_of_the_single_look_ups(spark, docs, chunk):
    lines = R.of_documents(docs, "doc")
    sums = R.tax_sums(lines, "doc", "CGST", "SGST")
    zero = F.lit(0).cast(A.MONEY)
    targets = R.fields(lines, "doc", chunk, sub=R.labelled(LABELS)).join(sums, "doc").select("doc", (F.col("sub") + F.coalesce("cgst", zero) + F.coalesce("sgst", zero)).cast(A.MONEY).alias("expected"))
    apart = targets.join(R.near_totals(lines, targets, "doc", "expected", chunk), "doc").join(R.search_down(lines, targets, "doc", "expected"), "doc").join(sums, "doc")
    got = R.expected_totals(lines, "doc", R.labelled(LABELS), "CGST", "SGST", chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, apart.select(got.columns).collect()), key=str) and got.where("larger is not null").count() > 0


def test_a_document_is_read_once(spark, docs):
    """Look-ups that have no column to align take a neighbour's last amount alone, and a line's amounts are read once, before it goes to its chunks."""
    lines = R.of_documents(docs, "doc")
    for d, scans in ((R.expected_totals(lines, "doc", R.labelled(LABELS), "CGST"), 1), (R.fields(lines, "doc", v=R.labelled(LABELS)), 1)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode") == scans and "lead(struct" not in plan
        above = plan[: plan.index("Generate explode")]
        assert "regexp_extract_all" not in above


def test_a_last_amount_is_the_last_of_the_list(spark):
    r = random.Random(5)
    words = ["12", "1234.50", "1234.567", "600001", "1,234.5", "12.", ".5", "-7", "+3.25", "A-77.10", "12-34-1995", "INV-9", "9999999999999999", "12345678901234567", "00012.30", "HSN", "SAC:", "8471", "5 NOS", "QTY", "PIN", "CHENNAI", "TOTAL", "é9", "_8", "7_", "5%", "\t4.50", "", "-", "\n6"]
    edge = [None, "", " ", "12", "-12", "HSN 8471", "PIN-600001", "X 99999999999999999.50", "A 5\n", "ITEM p1 45.00", "5 QTY 7"]
    d = spark.createDataFrame([(x,) for x in [*edge, *[" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(4000)]]], "line string")
    for capital in (False, True):
        got = d.select("line", F.expr(A.last_amount("line", capital)).alias("got"), F.expr(A.last(A.line_amounts("line", capital=capital))).alias("want")).collect()
        assert [x["line"] for x in got if x["got"] != x["want"]] == [] and sum(x["want"] is not None for x in got) > 1000


def test_a_plain_line_needs_no_list_and_no_function_places_it(spark, docs):
    """F16: a line's last amount has a short way before the list, and its chunks are compiled, without a lambda; no line is sent before the first chunk."""
    lines = R.of_documents(docs, "doc")
    plan = R.fields(lines, "doc", 4, v=R.labelled(LABELS))._jdf.queryExecution().optimizedPlan().toString()
    assert A.PLAIN in plan and "knownnotcontainsnull(filter(array(" not in plan
    rows, _ = R._chunked(lines, "doc", 4, 1, 4, line=F.col("line"))
    placed = {(x["n"], x["__chunk"]) for x in rows.where("doc = 'd6'").collect()}
    assert placed == {(n, c) for n, _ in placed for c in range(20) if 4 * c - 1 <= n < 4 * c + 8} and len(placed) > 60
