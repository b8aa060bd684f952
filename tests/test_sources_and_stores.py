"""Sources, sinks, history, usage and streams."""

import datetime as dt
import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_extraction import C1, C3
from vouchlake.operators import reports, store
from vouchlake.operators.extraction import extract
from vouchlake.sources import documents as S
from vouchlake.streaming import documents as stream


def test_files_archives_and_adaptive_text(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.PDF").write_bytes(("x" * 120 + "\f \fpage two").encode())
    (tmp_path / "in/deep/b.pdf").write_bytes(b"short")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    files = S.files(spark, str(tmp_path / "in"))
    assert sorted(r["name"] for r in files.collect()) == ["a.PDF", "b.pdf"]

    def ocr(raw):
        if raw == b"short":
            return "from the picture"
        raise ValueError("unreadable")

    got = {r["name"]: r for r in S.adaptive_text(files, S.form_feed_pages, ocr).collect()}
    assert got["a.PDF"]["text"] == "x" * 120 + "\npage two" and got["b.pdf"]["text"] == "from the picture"
    failed = {r["name"]: r for r in S.adaptive_text(files, S.form_feed_pages, lambda raw: 1 / 0, force_ocr=True).collect()}
    assert failed["a.PDF"]["text"] is None and "ZeroDivisionError" in failed["a.PDF"]["text_error"]
    fallback = {r["name"]: r["text"] for r in S.adaptive_text(files, S.plain_text, lambda raw: 1 / 0).collect()}
    assert fallback["b.pdf"] == "short"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/x.PDF", b"1")
        z.writestr("y.txt", b"2")
    zips = spark.createDataFrame([("a.zip", buffer.getvalue()), ("bad.zip", b"junk")], "path string, content binary")
    rows = {(r["archive"], r["name"]): r for r in S.archive_members(zips).collect()}
    assert bytes(rows["a.zip", "x.PDF"]["content"]) == b"1" and rows["bad.zip", None]["error"]
    uploads = spark.createDataFrame([("a.Pdf",), ("b.doc",), (None,)], "name string")
    assert [r["error"] for r in S.accepted(uploads).collect()] == [None, "Unsupported file type: b.doc", "Unsupported file type: "]
    long = spark.createDataFrame([("x" * 49,), ("x" * 50,), (None,)], "t string").select(S.enough_text(F.col("t")).alias("e")).collect()
    assert [r["e"] is None for r in long] == [False, True, False]
    assert S.copied(spark, files, str(tmp_path / "store")).count() == 2


def test_settings_and_counters(spark, tmp_path):
    (tmp_path / "k.txt").write_text("A = 1\nnothing\nB=x=y\n")
    assert {r["key"]: r["value"] for r in S.settings(spark, str(tmp_path / "k.txt")).collect()} == {"A": "1", "B": "x=y"}
    (tmp_path / "c.json").write_text('{"a@x": 3,\n "b@x": 1}')
    (tmp_path / "bad.json").write_text("{nope")
    assert {(r["email"], r["n"]) for r in S.counters(spark, str(tmp_path / "c.json")).collect()} == {("a@x", 3), ("b@x", 1)}
    assert S.counters(spark, str(tmp_path / "bad.json")).count() == 0
    S.write_counters(S.counters(spark, str(tmp_path / "c.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_model_records(spark):
    docs = spark.createDataFrame([("good",), ("bad",), ("fails",)], "text string")

    def provider(t):
        if t == "fails":
            raise TimeoutError
        return 'sure: {"Invoice Number": "A1", "Taxable Amount": "1,000.50", "Final Amount": "null"}' if t == "good" else "no json"

    got = {r["text"]: r["model"] for r in S.model_records(docs, provider).collect()}
    m = got["good"]
    assert got["bad"] is None and got["fails"] is None and float(m["taxable_amount"]) == 1000.5 and m["final_amount"] is None
    assert m["confidence"]["invoice_number"] == 0.85 and m["confidence"]["gst_number"] == 0.4 and m["rules_applied"] == ["AI_MODEL_EXTRACTION"]
    assert S.model_records(docs, None).where("model is not null").count() == 0


def test_history_and_usage(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "a", at + dt.timedelta(seconds=i // 2)) for i in range(12)] + [(99, "b", at)]
    h = spark.createDataFrame(rows, "id long, email string, created_at timestamp")
    assert [r["id"] for r in store.latest(h, "a", 3).collect()] == [11, 10, 9]
    assert store.latest(h, "a", 0).count() == 1 and store.latest(h, "a", 100).count() == 12
    got = {r["id"]: r["can_download_xml"] for r in store.history(h, "a", 25).collect()}
    assert [i for i in got if not got[i]] == [11, 10]
    usage = spark.createDataFrame([("a", 9), (" A ", None)], "email string, usage_count long")
    after = {r["email"]: r["usage_count"] for r in store.incremented(usage, spark.createDataFrame([("a",), ("new",)], "email string")).collect()}
    assert after == {"a": 10, " A ": 0, "new": 1}
    assert store.usage_of(usage, "nobody").first()[0] == 0
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("p", 50)], "email string, batch int")
    gates = {(r["email"], r["batch"]): r for r in store.gate(requests, usage, spark.createDataFrame([("p",)], "email string")).collect()}
    assert gates["a", 1]["bulk"]["allowed"] and not gates["a", 2]["bulk"]["allowed"] and gates["a", 2]["bulk"]["remaining"] == 1
    assert gates["p", 50]["single_allowed"] and not gates["p", 50]["bulk"]["allowed"]
    emails = spark.createDataFrame([(" A@X.com ",), ("a@x.com",)], "email string")
    assert store.upload_counts(emails).first()["n"] == 2 and store.user_counts(emails).count() == 2


def test_reports_and_vouchers(spark, tmp_path):
    df = extract(spark.createDataFrame([("c1", C1), ("c3", C3)], "k string, text string"))
    sheet = {r["Invoice Number"]: r for r in reports.sheet_marks(reports.sheet_rows(df, F.lit("S"), F.lit("x/y.pdf"))).collect()}
    assert (sheet["77"]["Taxable Value"], sheet["77"]["CGST"], sheet["77"]["validation_ok"]) == (500.0, 0.0, True)
    assert (sheet["INV-1001"]["Date"], sheet["INV-1001"]["Source File Name"], sheet["INV-1001"]["gstin_ok"]) == ("2024-03-05", "y.pdf", True)
    bulk = reports.bulk_rows(df, F.col("k"), F.lit("S"), F.when(F.col("k") == "c3", "broke"), F.lit("o")).collect()
    bad = [r for r in bulk if r["Validation Status"] == "FAILED"][0].asDict()
    assert sum(v is None for v in bad.values()) == 10 and bad["Rules Applied"] == "broke"
    xml = df.where("k = 'c1'").select(reports.voucher_xml(F.col("invoice")).alias("x"), reports.merged_voucher_xml(F.col("invoice")).alias("m"), reports.simple_voucher_xml(F.lit("G&<"), F.lit("05-03-2024"), F.lit(118), F.lit(18)).alias("s")).first()
    assert "<DATE>20240305</DATE>" in xml["x"] and "<AMOUNT>-1062.00</AMOUNT>" in xml["x"] and "<PARTYGSTIN />" in xml["x"] and xml["x"].count("Output") == 2
    assert "Output GST" in xml["m"] and "<AMOUNT>162.00</AMOUNT>" in xml["m"] and "VOUCHERNUMBER" not in xml["m"]
    assert "<DATE>05032024</DATE>" in xml["s"] and "G&amp;&lt;" in xml["s"] and "<AMOUNT>100.00</AMOUNT>" in xml["s"]
    reports.write_vouchers(df, reports.voucher_xml(F.col("invoice")), str(tmp_path / "v"))
    reports.write_sheet(reports.batch_summary(reports.bulk_rows(df, F.col("k"), F.lit("S"), F.lit(None).cast("string"), F.lit("o"))), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "v")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 2
    assert {r["Status"] for r in reports.confidence_rows(df, ["k"]).collect()} == {"✅ High", "⚠️ Medium", "❌ Review"}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, C1, dt.datetime(2024, 1, 1)), (2, C3, dt.datetime(2024, 1, 1))], "doc_id bigint, text string, arrived timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.extracted(stream.arriving(spark, str(tmp_path / "in"))).select("doc_id", "status").writeStream.format("memory").queryName("got").start()
    q.processAllAvailable()
    q.stop()
    assert {(r[0], r[1]) for r in spark.table("got").collect()} == {(1, "VALID"), (2, "Non GST Invoice")}
    counted = stream.usage(stream.arriving(spark, str(tmp_path / "in")).withColumn("email", F.lit("a"))).writeStream.outputMode("complete").format("memory").queryName("n").start()
    counted.processAllAvailable()
    counted.stop()
    assert spark.table("n").first()["n"] == 2


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE history_test LOCATION '{tmp_path / 'history'}'")
    try:
        store.create_tables(spark, "history_test")
        store.create_tables(spark, "history_test")
        h = spark.createDataFrame([(C1,)], "text string")
        for more in (h.unionByName(h), h, h):
            store.append_history(store.history_rows(extract(more), F.lit("a"), F.lit(None).cast("string"), F.lit("VALID")), "history_test.invoices")
        t = spark.table("history_test.invoices")
        assert t.count() == 4 and t.select("id").distinct().count() == 4  # unique over appends
    finally:
        spark.sql("DROP DATABASE history_test CASCADE")


def test_small_archives_share_batches(spark):
    """Small members and archives share Arrow batches, in place of one each; keys, null among them, and members stay whole over the slices' borders."""
    rows = [(None if k == 7 else f"c{k:03d}", f"m{m}.pdf", bytes([k % 256]) * (m * 40_000)) for k in range(30) for m in range(8)]
    files = spark.createDataFrame(rows, "c string, name string, content binary")
    archives = S.bundled(files, "c").withColumnRenamed("c", "path")
    assert archives.count() == 30
    got = {(r["archive"], r["name"]): bytes(r["content"]) for r in S.archive_members(archives).collect()}
    assert got == {(c, n): b for c, n, b in rows}
    made = list(S.collected(((i,) for i in range(10_000)), pa.schema([("x", pa.int64())]), lambda r: 8))
    assert len(made) == 1 and made[0].num_rows == 10_000
    assert [b.num_rows for b in S.collected(((i,) for i in range(5)), pa.schema([("x", pa.int64())]), lambda r: 3_000_000)] == [1] * 5
    long = pa.RecordBatch.from_arrays([pa.array([b"x" * 1_500_000] * 6 + [None])], ["content"])
    assert [b.num_rows for b in S.sliced([long])] == [2, 3, 2]


def test_contents_come_in_short_arrow_batches(spark):
    """An extractor's batches hold few contents, where the session has Spark's default of ten thousand rows."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        docs = spark.range(3).select("id", F.lit("text").cast("binary").alias("content"))
        assert [r["got"]["text"] for r in S.extracted(docs, S.plain_text, "got").collect()] == ["text"] * 3
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
