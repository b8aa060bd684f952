"""Registered queries over lines as rows, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import line_rows as R
from ..operators.extraction import TAXABLE_LABELS
from .queries import INVOICES
from .registry import query
from .rendered import rendered


@query("line_row_fields", INVOICES + """
SELECT doc_id, CAST(sub AS double) AS taxable, CAST(grand AS double) AS grand, CAST(CASE WHEN halves THEN cgst END AS double) AS cgst, CAST(CASE WHEN NOT halves THEN igst END AS double) AS igst
FROM parts""")
def line_row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values of rendered invoices whose lines are rows, in chunks of four lines, so that frames cross borders."""
    lines = R.of_documents(rendered(spark, sf_dir), "doc_id")
    found = R.fields(lines, "doc_id", 4, taxable=R.labelled(TAXABLE_LABELS), grand=R.labelled(["GRAND TOTAL"]), cgst=R.labelled(["CGST"]), igst=R.labelled(["IGST"]))
    return found.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("taxable", "grand", "cgst", "igst")])


@query("line_row_totals", INVOICES + """
, rows AS (SELECT doc_id, halves, cgst, sgst, igst, sub, grand, CASE WHEN halves THEN sgst ELSE igst END AS above FROM parts),
-- Beside the one total line stand the tax line above it and the total; the sub total is no total word's line but holds the word.
near AS (
  SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v - expected), k) AS r
  FROM checked JOIN (
    SELECT doc_id, unnest([item, sub, after, above, grand]) AS v, unnest([1, 2, 3, 4, 5]) AS k
    FROM (SELECT r.*, CASE WHEN r.halves THEN r.cgst ELSE r.igst END AS after,
        CAST(regexp_extract(p.text, ' ([0-9.]+)\\nSUB TOTAL', 1) AS decimal(18,2)) AS item FROM rows r JOIN parts p USING (doc_id))) USING (doc_id))
SELECT doc_id, CAST(v AS double) AS near, CAST(CASE WHEN grand > expected THEN grand END AS double) AS larger,
  CAST(CASE WHEN doc_id % 2 = 0 THEN cgst END AS double) AS cgst, CAST(CASE WHEN doc_id % 2 = 1 THEN igst END AS double) AS igst
FROM near JOIN checked USING (doc_id) WHERE r = 1""")
def line_row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, nearest and larger totals of rendered invoices whose lines are rows, against the expected totals."""
    lines = R.of_documents(rendered(spark, sf_dir), "doc_id")
    got = R.expected_totals(lines, "doc_id", R.labelled(["SUB TOTAL"]), "CGST", "SGST", "IGST", chunk=4)
    return got.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("near", "larger", "cgst", "igst")])


SQL_AMOUNTS = r"'\b\d+(?:,\d{3})*(?:\.\d{1,2})?\b'"


@query("sql_lines", INVOICES + f"""
, per_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM texts)
SELECT doc_id, CAST(n AS int) AS n, line, CAST(list_sum(list_transform(regexp_extract_all(line, {SQL_AMOUNTS}), lambda x: CAST(x AS decimal(18,2)))) AS double) AS total
FROM per_line WHERE regexp_matches(line, {SQL_AMOUNTS}) AND NOT line LIKE '%p%'""")
def sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of rendered invoices with amounts, by a SQL table function in a lateral join."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, l.n, l.line, CAST(aggregate(l.amounts, CAST(0 AS decimal(18,2)), (a, v) -> CAST(a + v AS decimal(18,2))) AS double) AS total FROM {docs} d, LATERAL document_lines(d.text) l WHERE size(l.amounts) > 0 AND NOT l.line LIKE '%ITEM%'", docs=rendered(spark, sf_dir))


@query("sql_fields", INVOICES + """
SELECT doc_id, concat('INV-', CAST(doc_id AS varchar)) AS invoice_no, CAST(sub AS double) AS taxable, CAST(CASE WHEN halves THEN cgst END AS double) AS cgst, CAST(grand AS double) AS nearest, grand > 100000 AS large FROM parts""")
def sql_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of rendered invoices by SQL functions, in plain SQL."""
    sql.register(spark, "own_")
    return spark.sql(
        "SELECT doc_id, own_invoice_number(text) AS invoice_no, CAST(own_labelled_amount(text, 'SUB TOTAL') AS double) AS taxable, CAST(own_tax_sum(text, 'CGST') AS double) AS cgst, "
        "CAST(own_closest_amount(own_text_amounts(text), own_labelled_amount(text, 'GRAND TOTAL'), CAST(0 AS decimal(18,2))) AS double) AS nearest, own_labelled_amount(text, 'GRAND TOTAL') > 100000 AS large FROM {docs}",
        docs=rendered(spark, sf_dir),
    )
