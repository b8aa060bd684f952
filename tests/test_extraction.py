"""Goldens of extraction and its functions, hand-traced; edges of every operator family."""

import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchlake.functions import amounts as A
from vouchlake.functions import dates as D
from vouchlake.functions import text as T
from vouchlake.functions.text import normalize, normalized_again
from vouchlake.operators import reconcile as R
from vouchlake.operators.extraction import extract, items, sections, tax_summary

C1 = "TAX INVOICE\nINVOICE NO: INV-1001\nINVOICE DATE: 05-03-2024\nGSTIN: 27AAPFU0939F1ZV\nDESCRIPTION HSN QTY RATE AMOUNT\nBOLT 900.00\nSUB TOTAL 900.00\nCGST 81.00\nSGST 81.00\nGRAND TOTAL 1062.00"
C2 = C1.replace("CGST 81.00\nSGST 81.00", "IGST 162.00")
C3 = "BILL NO: 77\nDATE 01/02/2024\nSERVICE FEE 500.00\nTOTAL 500.00"
C4 = C1 + "\nAMOUNT IN WORDS: ONE THOUSAND SIXTY TWO ONLY"
TABLE = "HSN/SAC TAXABLE VALUE IGST\n8471 1000.00 18% 180.00\nTOTAL 1000.00 180.00"


@pytest.fixture(scope="module")
def found(spark):
    rows = [("c1", C1), ("c2", C2), ("c3", C3), ("c4", C4), ("empty", ""), ("null", None), ("freight", C1.replace("SUB TOTAL 900.00", "FREIGHT 50.00\nSUB TOTAL 900.00")), ("round", C1.replace("GRAND TOTAL 1062.00", "ROUND OFF -0.40\nGRAND TOTAL 1061.60"))]
    df = extract(spark.createDataFrame(rows, "k string, text string"))
    return {r["k"]: r for r in df.withColumn("status", R.status(F.col("invoice"))).withColumn("audit", R.audit(F.col("invoice"))).withColumn("score", R.confidence_mean(F.col("invoice.confidence"))).collect()}


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_intra_state(found):
    r, i = found["c1"], found["c1"]["invoice"]
    assert (i["invoice_number"], i["invoice_date"], i["gst_number"]) == ("INV-1001", "05-03-2024", "27AAPFU0939F1ZV")
    assert [float(i[k]) for k in ("taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "total_tax_amount", "round_off", "final_amount")] == [900, 81, 81, 0, 162, 0, 1062]
    assert (float(i["math_expected_total"]), float(i["math_difference"]), i["validation"], i["requires_manual_review"]) == (1062, 0, "Verified", False)
    assert (i["overall_confidence"], r["score"], r["status"]) == (0.5, 91.78, "VALID")
    assert i["rules_applied"] == ["INVOICE_NO_WITH_SUFFIX", "CGST_MULTI_LINE_SUM", "SGST_MULTI_LINE_SUM", "TOTAL_TAX_FROM_9_PERCENT_COMPONENTS", "GRAND_TOTAL_PRIORITY", "REJECT_SMALL_TOTAL_AND_SEARCH_DOWN", "MATH_VALIDATION", "TOTAL_BLOCK_PRIORITY", "WORDS_TOTAL_MATCH"]
    assert set(r["audit"]) == {"gst_number", "taxable_amount", "final_amount"}


def test_inter_state(found):
    r, i = found["c2"], found["c2"]["invoice"]
    assert [float(i[k]) for k in ("taxable_amount", "igst_amount", "final_amount", "total_tax_amount", "math_expected_total", "math_difference")] == [900, 162, 1062, 162, 900, 162]
    assert (i["validation"], i["requires_manual_review"], r["status"], i["overall_confidence"]) == ("Math Mismatch", True, "REQUIRES MANUAL REVIEW", 0.475)


def test_strict_counts_the_inter_state_tax(spark):
    i = extract(spark.createDataFrame([(C2,)], "text string"), strict=True).first()["invoice"]
    assert i["validation"] == "Verified" and float(i["math_difference"]) == 0


def test_outside_the_tax_regime(found):
    r, i = found["c3"], found["c3"]["invoice"]
    assert (i["invoice_number"], i["invoice_date"], i["taxable_amount"], float(i["final_amount"]), float(i["math_difference"])) == ("77", "01/02/2024", None, 500, 500)
    assert (i["validation"], r["status"], i["overall_confidence"], r["score"]) == ("Non GST Invoice", "Non GST Invoice", 0.2875, 76.29)


def test_words_total(found):
    i = found["c4"]["invoice"]
    assert (float(i["amount_in_words"]), i["overall_confidence"], found["c4"]["score"]) == (1062, 0.525, 93.0)
    assert i["rules_applied"][-3:] == ["MATH_VALIDATION", "WORDS_TOTAL_MATCH", "TOTAL_BLOCK_PRIORITY"]


def test_odd_texts(found):
    assert found["empty"]["invoice"] == found["null"]["invoice"] and found["empty"]["invoice"]["final_amount"] is None
    assert float(found["freight"]["invoice"]["taxable_amount"]) == 950 and "TAXABLE_INCLUDES_FREIGHT_FROM_ITEMS" in found["freight"]["invoice"]["rules_applied"]
    assert float(found["round"]["invoice"]["round_off"]) == -0.4 and found["round"]["invoice"]["validation"] == "Verified"


@pytest.mark.parametrize(("line", "want"), [("CGST 9% 900.00", [9, 900]), ("HSN 8471 5 NOS 900.00", [900]), ("HSN 8471 5 NOS 1900.00", []), ("PIN 600001", []), ("SHIPPING 123456.00", []), ("12.345", [12, 345]), ("", []), ("1,000.50 x", [1000.5])])
def test_amounts(spark, line, want):
    assert [float(x) for x in one(spark, lambda x: F.expr(A.line_amounts("x")), line)] == want


def test_scalars(spark):
    assert one(spark, T.normalize, "Particulars: Rs. 1,250.00\r\n") == "PARTICULA:  1250.00"
    for words, n in (("ONE LAKH EIGHTEEN THOUSAND FIVE HUNDRED", 118500), ("TWO LAKHS FIVE", 7), ("ONE HUNDRED RUPEES AND FIFTY PAISE", 150), ("", None), ("ONLY", None), ("TWENTY-ONE", 21)):
        assert one(spark, T.words_to_number, words) == n
    for g, ok in (("27AAPFU0939F1ZV", True), ("27AAPFU0939F1ZX", False), (None, False), ("27AAPFU0939F1Z", False), (" 27aapfu0939f1zv ", True)):
        assert one(spark, T.gstin_valid, g) is ok
    for x, n in (("1,000.50", 1000.5), ("null", None), ("abc", None), ("", None)):
        assert one(spark, T.coerce_double, x) == n
    for x, n in (("05-03-2024", "20240305"), ("5-3-2024", "20240305"), ("05-JAN-2024", "20240105"), ("05.03.2024", "05032024"), ("", "")):
        assert one(spark, D.voucher_date, x) == n
    for x, n in (("05-03-2024", "2024-03-05"), ("03/25/2024", "2024-03-25"), ("2024-3-5", "2024-03-05"), ("5 MAR 2024", "2024-03-05"), ("99/99/2024", None)):
        assert one(spark, D.normalized_date, x) == n
    for x, n in ((0.95, "✅ High"), (0.9499, "⚠️ Medium"), (0.85, "⚠️ Medium"), (0.8499, "❌ Review")):
        assert one(spark, T.confidence_label, x, "double") == n
    assert one(spark, T.json_object, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and one(spark, T.json_object, "no } {") is None
    assert one(spark, T.safe_name, "a/b/re port*.x lsx") == "re_port.xlsx" and one(spark, T.safe_name, "...") == "invoice"
    assert one(spark, T.xlsx_name, "a.PDF") == "a.xlsx" and one(spark, T.xlsx_name, None) == "invoice.xlsx" and one(spark, T.xlsx_name, "b.XLSX") == "b.XLSX"


def test_lines(spark):
    def look(f, text):
        return spark.createDataFrame([(text,)], "text string").select(F.expr(A.analyzed("text")).alias("L")).select(F.expr(f("L"))).first()[0]

    assert look(A.round_off, "ROUND OFF -0.40") == Decimal("-0.40") and look(A.round_off, "ROUND OFF - 0.40") == Decimal("0.40")
    assert look(lambda x: A.tax_sum(x, "CGST"), "CGST 10.00\nCGST 5.00\nTOTAL CGST 15.00") == 15
    assert look(lambda x: A.tax_sum(x, "CGST"), "TOTAL CGST 15.00\nCGST TOTAL 9.00") == 15
    assert look(lambda x: A.labelled(x, ["NET"]), "NET\n7.00\nNET 8.00") == 7
    assert look(lambda x: A.column_tax(x, "CGST"), "CGST RATE TAX AMOUNT\n9.00      8.00      77.00") == Decimal("77.00")
    assert look(lambda x: A.rate_tax(x, "CGST"), "CGST 9%\n\n45.00") == 45
    s = look(tax_summary, TABLE)
    assert [float(s[k]) for k in ("taxable", "tax", "line_taxable", "line_tax", "igst")] == [1000, 180, 1000, 198, 180]
    at = look(sections, C1)
    assert (at["item"], at["tax"], at["total"]) == (5, 8, 10)
    assert [(i["hsn_code"], i["description"], float(i["amount"])) for i in look(items, "NUT 10.00\nTOTAL 1\n- BOLT 8471 x 2.50")] == [(None, "NUT", 10.0), ("8471", "BOLT x", 2.5)]


def test_closest_keeps_the_first(spark):
    d = spark.createDataFrame([([Decimal(10), Decimal(9)], Decimal("9.5"))], "v array<decimal(18,2)>, t decimal(18,2)")
    assert d.select(F.expr(A.closest("v", "t", "1"))).first()[0] == 10


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 13), st.integers(1, 35))
def test_checksum_sees_single_changes(spark, at, by):
    g = "27AAPFU0939F1ZV"
    other = T.GSTIN_ALPHABET[(T.GSTIN_ALPHABET.index(g[at]) + by) % 36]
    assert one(spark, T.gstin_valid, g[:at] + other + g[at + 1 :]) is False


def test_status_branches(spark):
    fields = "invoice_type string, validation string, requires_manual_review boolean, final_amount decimal(18,2), is_gst_invoice boolean, cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), sub_total decimal(18,2), taxable_amount decimal(18,2)"
    d = Decimal
    cases = [
        (None, "INVALID DATA"), (("GST Invoice", "Verified", False, d(0), True, d(1), d(1), d(0), d(9), d(9)), "FINAL AMOUNT MISSING"),
        (("GST Invoice", "Verified", False, d(9), True, None, d(0), d(0), d(9), d(9)), "GST DETECTED BUT TAX AMOUNT MISSING"),
        (("GST Invoice", "Verified", False, d(15), True, d(1), d(1), d(0), None, d(9)), "TAX MISMATCH (Expected 11.0, Found 15.0)"),
        (("GST Invoice", "Verified", False, d(12), True, d(1), d(1), d(0), d(0), d(9)), "VALID"), (("x", "Verified", False, d(12), False, None, None, None, None, None), "VALID (NON-GST)"),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], f"i struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    assert [r[0] for r in rows.select(R.status(F.col("i"))).collect()] == [want for _, want in cases]
    t = spark.createDataFrame([(d(900), None, d(81), d(81), d(0), d(0), d("1062.01"))], "taxable_amount decimal(18,2), total_tax_amount decimal(18,2), cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), round_off decimal(18,2), final_amount decimal(18,2)")
    assert tuple(t.select(R.tax_math(F.struct("*")).alias("m")).first()["m"]) == (True, d("1062.00"), d("0.01"))


def test_retry_replaces_only_improvements(spark):
    first = extract(spark.createDataFrame([(1, C1), (2, C2), (3, C3), (2, C2)], "k int, text string"))
    seen = []

    def rescan(rows):
        seen.extend(r["k"] for r in rows.select("k").collect())
        return extract(rows.withColumn("text", F.when(F.col("k") == 2, C1).otherwise(C3)))

    got = sorted((r["k"], r["invoice"]["validation"]) for r in R.retried(first, rescan).collect())
    assert sorted(seen) == [2, 2, 3] and got == [(1, "Verified"), (2, "Verified"), (2, "Verified"), (3, "Non GST Invoice")]


def test_status_prints_plain_digits(spark):
    d = Decimal
    fields = "invoice_type string, validation string, requires_manual_review boolean, final_amount decimal(18,2), is_gst_invoice boolean, cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), sub_total decimal(18,2), taxable_amount decimal(18,2)"
    row = lambda final, net: (("GST Invoice", "Verified", False, final, True, d(2), d(3), d(0), net, net),)
    rows = spark.createDataFrame([row(d("12345678.90"), d(20000000)), row(d("1234567890123.05"), d("0.45"))], f"i struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    assert [r[0] for r in rows.select(R.status(F.col("i"))).collect()] == ["TAX MISMATCH (Expected 20000005.0, Found 12345678.9)", "TAX MISMATCH (Expected 5.45, Found 1234567890123.05)"]


def test_callers_columns_may_have_the_stages_names(spark):
    stages = ["items", "words", "difference", "s", "r", "f", "net", "near", "tx", "at", "expected", "resort", "_t", "_L", "conf", "keep", "ro", "final0", "v_no", "e_no", "math_ok", "a b.c"]
    docs = spark.createDataFrame([(1, C1, *["own"] * len(stages))], "k int, text string, " + ", ".join(f"`{c}` string" for c in stages))
    got = extract(docs)
    row = got.first()
    assert got.columns == [*docs.columns, "invoice"] and all(row[c] == "own" for c in stages)
    assert row["invoice"] == extract(docs.select("text")).first()["invoice"]
    again = extract(extract(docs).withColumn("text", F.lit(C2)))  # an `invoice` of the caller is replaced
    assert again.columns == got.columns and again.first()["invoice"] == extract(spark.createDataFrame([(C2,)], "text string")).first()["invoice"]
    assert extract(docs.withColumnRenamed("text", "a b"), text="a b").first()["invoice"] == row["invoice"]


def test_a_key_filter_reaches_the_scan_and_an_invoice_filter_stays_above(spark, tmp_path):
    spark.createDataFrame([(1, C1, "x"), (2, C2, "x")], "k int, text string, unused string").write.parquet(f"{tmp_path}/docs")
    got = extract(spark.read.parquet(f"{tmp_path}/docs"))
    plan = got.where("k = 2").select("k", "invoice")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,2)" in plan and "unused" not in plan.split("ReadSchema")[1]
    optimized = got.where("invoice.validation = 'Verified'")._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.index("Filter") < optimized.index("Generate explode") and optimized.count("Filter") == 1
    assert [r["k"] for r in got.where("k = 2").collect()] == [2]


ODD = ["", " ", "a,b", "Inr 5", "rs. 7\n\n8", "i,nr 4", "R\u20b9S", "\u0131nr", "stra\u00dfe", "x\r\ny", "\x1c a \x1f", "plain text\nof 12.50 ", "\t\x0b\x0c end\n", "caf\u00e9 \u2028", "parts 5", None, "rrss"]


def test_the_short_way_of_normalizing_gives_what_the_long_way_does(spark):
    def long_way(t):
        x = re.sub("\u20b9|INR|RS\\.?", "", t.upper()).replace(",", "").replace("\r", "\n")
        return re.sub("\n+", "\n", re.sub(r"[^\x00-\x7f]+", " ", x)).strip(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")

    d = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", normalize(F.col("t")).alias("n"))
    for r in d.select("t", "n", normalized_again(F.col("n")).alias("again"), normalize(F.col("n")).alias("twice")).collect():
        assert r["n"] == (None if r["t"] is None else long_way(r["t"])) and r["again"] == r["twice"], r


def test_only_the_wanted_fields_are_computed_and_equal_the_whole_invoices(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([C1, C3, None, "", "TOTAL 5", "ROUND OFF 0.40\nGRAND TOTAL 100.40", "QTY AMOUNT\nITEM 4.00\nCGST 9 2.00\nTOTAL 6"])], "k int, text string")
    whole = extract(docs, strict=True)
    names = ["final_amount", "taxable_amount", "cgst_amount", "round_off", "validation", "rules_applied", "invoice_date"]
    some = extract(docs, strict=True, only=names)
    assert set(some.schema["invoice"].dataType.names) == set(names)
    of = lambda d: {r["k"]: [r[n] for n in names] for r in d.select("k", *[f"invoice.{n}" for n in names]).collect()}
    assert of(some) == of(whole)
    with pytest.raises(ValueError):
        extract(docs, only=["no_such_field"])
