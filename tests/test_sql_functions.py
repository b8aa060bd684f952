"""SQL functions and table functions against the expressions that extraction uses."""

from pyspark.sql import functions as F

from vouchlake.functions import amounts as A
from vouchlake.functions import sql
from vouchlake.functions.text import normalize
from vouchlake.operators import extraction as X

TEXTS = ["Tax Invoice\r\nInvoice No: AB-12/3\nDescription HSN Qty Rate\nPen 8471 2 NOS 1,234.50\nSub Total ₹1,234.50\n\ncgst 9% 111.11\nCGST 5.00\nGrand Total Rs.1,345.61", "GSTIN 27AAPFU0939F1ZV no amounts", "", None, "  café 5.5  \n\n 7 "]


def test_functions_give_what_the_expressions_give(spark):
    made = sql.register(spark)
    assert len(made) == len(set(made)) == len(sql.SCALARS) + len(sql.TABLES)
    d = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").withColumn("own", normalize(F.col("text")))
    d = d.withColumn("L", F.expr(A.analyzed("own")))
    want = d.select("k", "own", F.expr(A.tax_sum("L", "CGST")), F.expr(A.all_amounts("L")), F.expr(A.labelled_here("L", ["GRAND TOTAL"])), F.expr(X.gstin("own")), F.expr(f"coalesce({X.invoice_number('own')}, {X.invoice_number_fallback('own')})"))
    got = spark.sql("SELECT k, normalized_text(text), tax_sum(text, 'CGST'), text_amounts(text), labelled_amount(text, 'GRAND TOTAL'), gstin(text), invoice_number(text) FROM {d}", d=d)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    lines = spark.sql("SELECT k, l.n, l.line, l.amounts FROM {d}, LATERAL document_lines(text) l", d=d)
    want = d.select("k", F.posexplode("L").alias("n", "x")).select("k", "n", "x.line", "x.amts")
    assert sorted(map(str, map(tuple, lines.collect()))) == sorted(map(str, map(tuple, want.collect())))
    items = spark.sql("SELECT k, i.hsn_code, i.description, i.amount FROM {d}, LATERAL item_rows(text) i", d=d)
    want = d.select("k", F.explode(F.expr(X.items("L"))).alias("i")).select("k", "i.*")
    assert sorted(map(str, map(tuple, items.collect()))) == sorted(map(str, map(tuple, want.collect()))) and items.count() > 3
    assert spark.sql("SELECT closest_amount(array(1.00BD, 4.00BD, 3.00BD), 2.00BD, 1.50BD), closest_amount(array(9.00BD), 2.00BD, 1.50BD), is_close(1.00BD, 2.50BD)").first()[:] == (1, None, True)


def test_functions_need_no_python_and_let_filters_through(spark, tmp_path):
    sql.register(spark, "p_")
    spark.createDataFrame([(1, TEXTS[0], "x"), (2, TEXTS[1], "y")], "k int, text string, unused string").write.parquet(f"{tmp_path}/d")
    got = spark.sql("SELECT d.k, l.line FROM {d} d, LATERAL p_document_lines(d.text) l WHERE d.k = 2", d=spark.read.parquet(f"{tmp_path}/d"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "EqualTo(k,2)" in plan and "unused" not in plan and "Join" not in plan and got.count() == 1
