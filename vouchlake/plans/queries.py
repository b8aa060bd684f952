"""Registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import dates as D
from ..functions import text as T
from ..operators import reconcile as R
from ..operators import reports, store
from ..operators.extraction import extract, items
from .registry import query
from .rendered import DUCK, rendered

MONEY = A.MONEY


#: Fields of an invoice that the status ladder and the reports read.
AMOUNTS = ["taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "final_amount"]
STATUS = [*AMOUNTS, "sub_total", "invoice_type", "validation", "requires_manual_review", "is_gst_invoice"]
HISTORY = [*STATUS, "invoice_number", "invoice_date"]
SHEET = [*HISTORY, "gst_number", "confidence"]


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history table."""
    return tab(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("email"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total_amount")
    )


def dbl(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


# --------------------------------------------------------------------- whole invoices

#: The rendered invoices follow one form, so that SQL can say what extraction must find in them.
INVOICES = f"""
WITH texts AS ({DUCK}),
parts AS (
  SELECT doc_id, cust, text, doc_id % 2 = 0 AS halves,
    CAST(regexp_extract(text, '\\nSUB TOTAL ([0-9.]+)', 1) AS decimal(18,2)) AS sub,
    CAST(coalesce(nullif(regexp_extract(text, '\\nCGST ([0-9.]+)', 1), ''), '0') AS decimal(18,2)) AS cgst,
    CAST(coalesce(nullif(regexp_extract(text, '\\nSGST ([0-9.]+)', 1), ''), '0') AS decimal(18,2)) AS sgst,
    CAST(coalesce(nullif(regexp_extract(text, '\\nIGST ([0-9.]+)', 1), ''), '0') AS decimal(18,2)) AS igst,
    CAST(regexp_extract(text, '\\nGRAND TOTAL ([0-9.]+)', 1) AS decimal(18,2)) AS grand
  FROM texts),
-- A total that does not add up gives way to the nearest amount beside a total line: the sub total, where taxes are no more than the gap.
checked AS (
  SELECT *, sub + cgst + sgst + igst AS expected,
    CASE WHEN abs(grand - (sub + cgst + sgst + igst)) > 1 AND cgst + sgst + igst <= abs(grand - (sub + cgst + sgst + igst)) THEN sub ELSE grand END AS amount
  FROM parts)
"""


@query(
    "invoice_status",
    INVOICES
    + """
SELECT doc_id, concat('INV-', CAST(doc_id AS varchar)) AS invoice_no, CAST(sub AS double) AS taxable, CAST(cgst AS double) AS cgst,
  CAST(sgst AS double) AS sgst, CAST(igst AS double) AS igst, CAST(amount AS double) AS final_amount,
  CAST(expected AS double) AS expected, CAST(amount - expected AS double) AS difference,
  CASE WHEN cgst + sgst + igst = 0 THEN 'Non GST Invoice' WHEN abs(amount - expected) <= 1 THEN 'Verified' ELSE 'Math Mismatch' END AS validation,
  CASE WHEN cgst + sgst + igst = 0 THEN 'Non GST Invoice' WHEN abs(amount - expected) > 1 THEN 'REQUIRES MANUAL REVIEW' ELSE 'VALID' END AS status
FROM checked
""",
)
def invoice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rendered invoices, extracted, reconciled and given a status, in the strict mode."""
    got = extract(rendered(spark, sf_dir), strict=True, only=[*STATUS, "invoice_number", "math_expected_total", "math_difference"]).withColumn("status", R.status(F.col("invoice")))
    i = F.col("invoice")
    return got.select(
        "doc_id", i["invoice_number"].alias("invoice_no"),
        *[i[k].cast("double").alias(n) for k, n in (("taxable_amount", "taxable"), ("cgst_amount", "cgst"), ("sgst_amount", "sgst"), ("igst_amount", "igst"), ("final_amount", "final_amount"), ("math_expected_total", "expected"), ("math_difference", "difference"))],
        i["validation"].alias("validation"), "status",
    )


@query("invoice_compatible", INVOICES + """,
-- The compatible mode cuts a total after three digits, looks for a larger one on the total lines, and leaves the inter-state tax out of the sum.
cut AS (SELECT *, cgst + sgst + igst AS tax, CASE WHEN grand >= 1000 THEN CAST(substr(CAST(grand AS varchar), 1, 3) AS decimal(18,2)) ELSE grand END AS short FROM parts),
searched AS (SELECT *, CASE WHEN short < sub AND grand > sub THEN grand ELSE short END AS first_final, short < sub AND grand > sub AS larger FROM cut),
resorted AS (SELECT *, sub + cgst + sgst AS sum, CASE WHEN abs(first_final - (sub + cgst + sgst)) <= 1 THEN first_final WHEN tax <= abs(grand - (sub + tax)) THEN sub ELSE grand END AS final FROM searched)
SELECT doc_id, concat('INV-', CAST(doc_id AS varchar)) AS invoice_number, substr(text, strpos(text, 'DATE: ') + 6, 10) AS invoice_date,
  CASE WHEN tax = 0 THEN 'Non GST Invoice' WHEN abs(final - sum) <= 1 THEN 'Verified' ELSE 'Math Mismatch' END AS validation,
  final = 0 OR abs(final - sum) > 1 AS requires_manual_review,
  CASE WHEN tax = 0 THEN 'Non GST Invoice' WHEN final = 0 OR abs(final - sum) > 1 THEN 'REQUIRES MANUAL REVIEW'
    WHEN abs(sub + tax - final) > 2 THEN concat('TAX MISMATCH (Expected ', CAST(CAST(sub + tax AS double) AS varchar), ', Found ', CAST(CAST(final AS double) AS varchar), ')') ELSE 'VALID' END AS status,
  CASE WHEN abs(final - sum) <= 1 THEN 0.3125 ELSE 0.2875 END::double AS overall_confidence,
  concat_ws(', ', 'INVOICE_NUMBER_LABEL_PRIORITY', CASE WHEN halves THEN 'CGST_MULTI_LINE_SUM, SGST_MULTI_LINE_SUM' END, CASE WHEN cgst <> 0 AND sgst <> 0 THEN 'TOTAL_TAX_FROM_9_PERCENT_COMPONENTS' END, 'GRAND_TOTAL_PRIORITY',
    CASE WHEN larger THEN 'REJECT_SMALL_TOTAL_AND_SEARCH_DOWN' END, 'MATH_VALIDATION, TOTAL_BLOCK_PRIORITY, WORDS_TOTAL_MATCH') AS rules,
  CAST(sub AS double) AS taxable_amount, CAST(final AS double) AS final_amount, CASE WHEN tax > 0 THEN CAST(tax AS double) END AS total_tax_amount
FROM resorted""")
def invoice_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field in the compatible mode."""
    got = extract(rendered(spark, sf_dir), only=[*HISTORY, "overall_confidence", "rules_applied", "total_tax_amount"]).withColumn("status", R.status(F.col("invoice")))
    return got.select("doc_id", "status", *[F.col(f"invoice.{k}") for k in ("invoice_number", "invoice_date", "validation", "requires_manual_review", "overall_confidence")], F.array_join("invoice.rules_applied", ", ").alias("rules"), *dbl_invoice("taxable_amount", "final_amount", "total_tax_amount"))


def dbl_invoice(*names: str) -> list:
    return [F.col(f"invoice.{n}").cast("double").alias(n) for n in names]


# --------------------------------------------------------------------- text


@query(
    "text_normalize",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(
  regexp_replace(upper(replace(text, 'ß', 'ss')), '₹|INR|RS\.?', '', 'g'), ',', ''), chr(13), chr(10)),
  '[^\x00-\x7F]+', ' ', 'g'), '\n+', chr(10), 'g'), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS text FROM documents""",
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("text_lines", "SELECT doc_id, n - 1 AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


@query(
    "line_amounts",
    INVOICES
    + """
, per_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM texts)
SELECT doc_id, n, CAST(list_sum(list_transform(regexp_extract_all(line, '\\b\\d+(?:,\\d{3})*(?:\\.\\d{1,2})?\\b'), lambda x: CAST(x AS decimal(18,2)))) AS double) AS total,
  len(regexp_extract_all(line, '\\b\\d+(?:,\\d{3})*(?:\\.\\d{1,2})?\\b')) AS found
FROM per_line WHERE regexp_matches(line, '\\b\\d+(?:,\\d{3})*(?:\\.\\d{1,2})?\\b')
""",
)
def line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of every line that has one. The rendered texts have no word that would drop an amount."""
    rows = rendered(spark, sf_dir).select("doc_id", F.posexplode(F.expr(A.analyzed("text"))).alias("n", "x")).where(F.size("x.amts") > 0)
    total = F.aggregate("x.amts", F.lit(0).cast(MONEY), lambda a, v: (a + v).cast(MONEY))
    return rows.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), total.cast("double").alias("total"), F.size("x.amts").cast("long").alias("found"))


@query("words_number", "WITH n AS (SELECT DISTINCT (l_partkey * 4999 + l_suppkey * 7) % 1000000000 AS n FROM lineitem) SELECT n, CASE WHEN n > 0 THEN n END AS parsed FROM n")
def words_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of up to nine digits spelled out on the Indian scale, and read back."""
    small = ["", *list(T.NUMBER_WORDS)[1:20]]
    tens = ["", "", *list(T.NUMBER_WORDS)[20:]]
    below_100 = [small[x] if x < 20 else f"{tens[x // 10]}-{small[x % 10]}" for x in range(100)]

    def named(over, below, word):
        """What a scale counts: n over `over`, below `below`, with the scale's word; empty for none."""
        words = ", ".join(f"'{below_100[x]}{word}'" if x else "''" for x in range(below))
        return F.expr(f"get(array({words}), CAST(n div {over} % {below} AS int))")

    scales = [(10_000_000, 100, " CRORE "), (100_000, 100, " LAKH "), (1_000, 100, " THOUSAND "), (100, 10, " HUNDRED "), (1, 100, "")]
    spelled = F.concat(F.lit("RUPEES "), *[named(*x) for x in scales], F.lit(" ONLY"))
    numbers = tab(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 4999 + F.col("l_suppkey") * 7) % 1_000_000_000).alias("n")).distinct()
    return numbers.select("n", T.words_to_number(spelled).alias("parsed"))


GSTIN_SQL = """
WITH c AS (SELECT c_custkey, concat(lpad(CAST(c_custkey % 37 AS varchar), 2, '0'), 'ABCDE', lpad(CAST(c_custkey % 10000 AS varchar), 4, '0'), 'F1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 36 AS integer) + 1, 1)) AS g FROM customer),
t AS (SELECT c_custkey, g, list_sum(list_transform(range(1, 15), lambda i: ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(g, CAST(i AS bigint), 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) // 36 + ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(g, CAST(i AS bigint), 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) % 36)) AS total FROM c)
SELECT c_custkey, g AS gstin, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - total % 36) % 36 AS bigint) + 1, 1) = substr(g, 15, 1) AS valid FROM t"""


@query("gstin_check", GSTIN_SQL)
def gstin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    g = F.concat(F.lpad((k % 37).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z"), F.substr(F.lit(T.GSTIN_ALPHABET), (k % 36).cast("int") + 1, F.lit(1)))
    return tab(spark, sf_dir, "customer").select("c_custkey", g.alias("gstin"), T.gstin_valid(g).alias("valid"))


@query("coerce_number", r"""SELECT event_id, try_cast(nullif(regexp_replace(props, '[^\d.-]', '', 'g'), '') AS double) AS value FROM events""")
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "events").select("event_id", T.coerce_double(F.col("props")).alias("value"))


@query("json_fields", """SELECT event_id, len(json_keys(props::json)) AS n FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the JSON object found inside a noisy reply."""
    noisy = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done."))
    return tab(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys(T.json_object(noisy))).cast("long").alias("n"))


@query("file_names", r"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS base, regexp_extract(regexp_extract(url, '[^/]*$'), '[^./][^/]*?(\.[^./]*)$', 1) AS ext FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(substr(base, 1, len(base) - len(ext)), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS stem FROM b)
SELECT page_id, concat(CASE WHEN stem = '' THEN 'invoice' ELSE stem END, regexp_replace(ext, '[^A-Za-z0-9.]', '', 'g')) AS name, lower(trim(url)) AS email FROM c""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.email_key(F.col("url")).alias("email"))


@query("sheet_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '.XLSX') WHEN p_partkey % 3 = 1 THEN concat(p_name, '.xlsx') ELSE concat(p_name, '.xlsx') END AS name FROM part")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    given = F.concat(F.col("p_name"), F.when(k == 0, ".XLSX").when(k == 1, ".pdf").otherwise(""))
    return tab(spark, sf_dir, "part").select("p_partkey", T.xlsx_name(given).alias("name"))


@query("identifier_kinds", "SELECT doc_id, regexp_matches(upper(text), 'UDYAM|MSME|LUT|ARN') AS other FROM documents")
def identifier_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").select("doc_id", T.other_identifier(F.upper("text")).alias("other"))


@query("machine_hash", "SELECT s_suppkey, sha256(s_name) AS hash FROM supplier")
def machine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "supplier").select("s_suppkey", T.machine_hash(F.col("s_name")).alias("hash"))


# --------------------------------------------------------------------- fields


@query("labelled_amount", INVOICES + "SELECT doc_id, CAST(sub AS double) AS sub_total, CAST(grand AS double) AS grand_total FROM parts")
def labelled_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rendered(spark, sf_dir).select("doc_id", F.expr(A.analyzed("text")).alias("L"))
    return d.select("doc_id", F.expr(A.labelled("L", ["SUB TOTAL"])).cast("double").alias("sub_total"), F.expr(A.labelled("L", ["GRAND TOTAL"])).cast("double").alias("grand_total"))


@query("item_rows", INVOICES + """, per_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
SELECT doc_id, count(*) AS n, CAST(sum(CAST(regexp_extract(line, '([0-9.]+)$', 1) AS decimal(18,2))) AS double) AS total, min(regexp_extract(line, '^(ITEM p[0-9]+) ', 1)) AS first_item
FROM per_line WHERE line LIKE 'ITEM p%' GROUP BY doc_id""")
def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table as rows, and its sums."""
    d = rendered(spark, sf_dir).select("doc_id", F.expr(A.analyzed("text")).alias("L"))
    d = d.select("doc_id", F.explode(F.expr(items("L"))).alias("i")).where(F.startswith("i.description", F.lit("ITEM")))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("i.amount").cast("double").alias("total"), F.min("i.description").alias("first_item"))


@query("tax_sums", INVOICES + "SELECT doc_id, CASE WHEN halves THEN CAST(cgst AS double) END AS cgst, CASE WHEN halves THEN CAST(sgst AS double) END AS sgst, CASE WHEN NOT halves THEN CAST(igst AS double) END AS igst FROM parts")
def tax_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rendered(spark, sf_dir).select("doc_id", F.expr(A.analyzed("text")).alias("L"))
    return d.select("doc_id", *[F.expr(A.tax_sum("L", t.upper())).cast("double").alias(t) for t in ("cgst", "sgst", "igst")])


@query("item_sum", INVOICES + "SELECT doc_id, CAST(sub AS double) AS items FROM parts")
def item_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rendered(spark, sf_dir).select("doc_id", F.expr(A.analyzed("text")).alias("L"))
    return d.select("doc_id", F.expr(A.item_sum("L")).cast("double").alias("items"))


@query("closest_amount", """
WITH v AS (SELECT l_orderkey, CAST(l_extendedprice AS decimal(18,2)) AS x FROM lineitem),
t AS (SELECT o_orderkey, CAST(o_totalprice AS decimal(18,2)) / 4 AS target FROM orders)
SELECT o_orderkey, CAST(min(struct_pack(gap := abs(x - CAST(target AS decimal(18,2))), x := x)).x AS double) AS nearest FROM t JOIN v ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def closest_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tab(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast(MONEY).alias("x"))
    t = tab(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast(MONEY) / 4).cast(MONEY).alias("target"))
    near = t.join(v, t.o_orderkey == v.l_orderkey).groupBy("o_orderkey").agg(F.min(F.struct(F.abs(F.col("x") - F.col("target")).alias("gap"), "x")).alias("near"))
    return near.select("o_orderkey", F.col("near.x").cast("double").alias("nearest"))


@query("search_down", INVOICES + "SELECT doc_id, CASE WHEN grand > sub THEN CAST(grand AS double) END AS larger FROM parts")
def search_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rendered(spark, sf_dir).select("doc_id", F.expr(A.analyzed("text")).alias("L"))
    return d.select("doc_id", F.expr(A.search_down("L", A.labelled("L", ["SUB TOTAL"]))).cast("double").alias("larger"))


# --------------------------------------------------------------------- reconciliation


RECON = """
WITH l AS (SELECT l_orderkey, CAST(sum(CAST(round(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(4,2))), 2) AS decimal(14,2))) AS decimal(18,2)) AS net FROM lineitem GROUP BY l_orderkey)
"""


@query("reconcile_orders", RECON + """
SELECT o_orderkey, coalesce(CAST(net AS double), 0) AS net, CAST(CAST(o_totalprice AS decimal(18,2)) - coalesce(net, 0) AS double) AS difference,
  abs(CAST(o_totalprice AS decimal(18,2)) - coalesce(net, 0)) <= 1.5 AS is_close FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
    l = tab(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(net, 2).cast("decimal(14,2)")).cast(MONEY).alias("net"))  # noqa: E741
    o = tab(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total, zero = F.col("o_totalprice").cast(MONEY), F.coalesce("net", F.lit(0).cast(MONEY))
    return o.select("o_orderkey", zero.cast("double").alias("net"), (total - zero).cast("double").alias("difference"), R.is_close(total, F.col("net")).alias("is_close"))


@query("confidence_mean", "SELECT part.p_partkey, p_size + (p_size % 7) * 6.25 AS mean, CASE WHEN p_size >= 48 THEN '✅ High' WHEN p_size >= 43 THEN '⚠️ Medium' ELSE '❌ Review' END AS label FROM part")
def confidence_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("p_size") / 50.0, F.lit("b"), (F.col("p_size") % 7) / 8.0)
    label = T.confidence_label(F.when(F.col("p_size") >= 48, 0.95).when(F.col("p_size") >= 43, 0.85).otherwise(0.8499))
    return tab(spark, sf_dir, "part").select("p_partkey", R.confidence_mean(m).alias("mean"), label.alias("label"))


@query("gst_totals", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_tax AS decimal(18,2)) + CAST(l_discount AS decimal(18,2)) + 0 AS double) AS gst, count(*) AS n FROM lineitem GROUP BY ALL")
def gst_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda c: F.col(c).cast(MONEY)
    g = R.gst_total(m("l_tax"), m("l_discount"), F.lit(None).cast(MONEY)).cast("double")
    return tab(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.alias("gst")).agg(F.count(F.lit(1)).alias("n"))


@query("status_ladder", """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_totalprice AS decimal(18,2)) AS total FROM orders),
s AS (
  SELECT o_orderkey, CASE k WHEN 0 THEN 'Non GST Invoice' WHEN 1 THEN 'REQUIRES MANUAL REVIEW' WHEN 2 THEN 'FINAL AMOUNT MISSING' WHEN 3 THEN 'GST DETECTED BUT TAX AMOUNT MISSING'
    WHEN 4 THEN 'VALID' WHEN 5 THEN 'VALID (NON-GST)' WHEN 6 THEN 'INVALID DATA'
    ELSE concat('TAX MISMATCH (Expected ', CAST(CAST(total * 2001 + 1 AS double) AS varchar), ', Found ', CAST(CAST(total * 2000 AS double) AS varchar), ')') END AS status
  FROM o)
SELECT o_orderkey, status, CASE WHEN status LIKE '%VALID%' THEN 'success' WHEN status LIKE '%MISMATCH%' THEN 'error' WHEN status LIKE '%MISSING%' THEN 'warning' ELSE 'info' END AS badge FROM s""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One branch of the ladder for each remainder of the key; mismatches have amounts of ten millions and more."""
    k, price = F.col("o_orderkey") % 8, F.col("o_totalprice").cast(MONEY)
    total = F.when(k == 7, price * 2000).otherwise(price).cast(MONEY)
    base = F.when(k == 7, price * 2001).otherwise(price).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    inv = F.when(k != 6, F.struct(
        F.when(k == 0, "Non-GST Invoice").otherwise("GST Invoice").alias("invoice_type"), F.lit("Verified").alias("validation"), (k == 1).alias("requires_manual_review"),
        F.when(k != 2, total).alias("final_amount"), (k != 5).alias("is_gst_invoice"), F.when(k.isin(4, 7), F.lit(1).cast(MONEY)).otherwise(zero).alias("cgst_amount"),
        zero.alias("sgst_amount"), zero.alias("igst_amount"), base.alias("sub_total"), base.alias("taxable_amount"),
    ))
    d = tab(spark, sf_dir, "orders").select("o_orderkey", R.status(inv).alias("status"))
    return d.withColumn("badge", T.status_badge(F.col("status")))


@query("retried_invoices", INVOICES + """,
cut AS (SELECT *, cgst + sgst + igst AS tax, CASE WHEN grand >= 1000 THEN CAST(substr(CAST(grand AS varchar), 1, 3) AS decimal(18,2)) ELSE grand END AS short FROM checked),
searched AS (SELECT *, CASE WHEN short < sub AND grand > sub THEN grand ELSE short END AS first_final FROM cut),
passes AS (
  SELECT *, CASE WHEN abs(first_final - (sub + cgst + sgst)) <= 1 THEN first_final WHEN tax <= abs(grand - (sub + tax)) THEN sub ELSE grand END AS final, sub + cgst + sgst AS sum FROM searched),
-- The second pass reads the text strictly; it replaces what needs review where it needs none itself.
judged AS (SELECT *, final = 0 OR abs(final - sum) > 1 AS review, amount = 0 OR abs(amount - expected) > 1 AS again FROM passes)
SELECT doc_id, CAST(CASE WHEN review AND NOT again THEN amount ELSE final END AS double) AS final_amount, review AND again AS requires_manual_review,
  CASE WHEN tax = 0 THEN 'Non GST Invoice' WHEN review AND again THEN 'Math Mismatch' ELSE 'Verified' END AS validation
FROM judged""")
def retried_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered invoices in the compatible mode; those that need review are read once more in the strict mode."""
    fields = ["final_amount", "requires_manual_review", "validation"]
    got = R.retried(extract(rendered(spark, sf_dir), only=fields), lambda rows: extract(rows, strict=True, only=fields))
    i = F.col("invoice")
    return got.select("doc_id", i["final_amount"].cast("double").alias("final_amount"), i["requires_manual_review"].alias("requires_manual_review"), i["validation"].alias("validation"))


# --------------------------------------------------------------------- history and usage


@query("user_counts", "SELECT CAST(user_id AS varchar) AS email, count(*) AS n FROM events GROUP BY 1")
def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.user_counts(tab(spark, sf_dir, "events").withColumn("email", F.col("user_id").cast("string")))


@query("usage_increment", "SELECT coalesce(CAST(c_custkey AS varchar), email) AS email, coalesce(CASE WHEN c_custkey IS NULL THEN 0 ELSE 2 END, 0) + coalesce(n, 0) AS usage_count FROM customer FULL JOIN (SELECT CAST(user_id AS varchar) AS email, count(*) AS n FROM events GROUP BY 1) e ON CAST(c_custkey AS varchar) = email")
def usage_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = tab(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("email"), F.lit(2).cast("long").alias("usage_count"))
    return store.incremented(usage, tab(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("email")))


@query("upload_counts", "SELECT lower(trim(concat(' U', CAST(user_id AS varchar), '@X.com '))) AS email, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def upload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tab(spark, sf_dir, "events").where("event_type is not null").select(F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit("@X.com ")).alias("email"))
    return store.upload_counts(e)


@query("quota_gate", """
WITH u AS (SELECT user_id, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY 1),
p AS (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 300),
r AS (SELECT DISTINCT user_id, CAST(user_id % 4 + 1 AS integer) AS batch FROM events)
SELECT CAST(r.user_id AS varchar) AS email, batch, coalesce(used, 0) AS used, p.user_id IS NOT NULL AS pro, p.user_id IS NOT NULL OR coalesce(used, 0) < 10 AS single_allowed,
  coalesce(used, 0) + batch <= 10 AS bulk_allowed, greatest(0, 10 - coalesce(used, 0)) AS remaining
FROM r LEFT JOIN u USING (user_id) LEFT JOIN p ON r.user_id = p.user_id""")
def quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are uploads; users with a large event have no limit."""
    e = tab(spark, sf_dir, "events").withColumn("email", F.col("user_id").cast("string"))
    usage = e.where("event_type = 'purchase'").groupBy("email").agg(F.count(F.lit(1)).alias("usage_count"))
    requests = e.select("email", (F.col("user_id") % 4 + 1).cast("int").alias("batch")).distinct()
    pro = e.groupBy("email").agg(F.max("value").alias("most")).where("most > 300").select("email")
    g = store.gate(requests, usage, pro)
    return g.select("email", "batch", "used", "pro", "single_allowed", F.col("bulk.allowed").alias("bulk_allowed"), F.col("bulk.remaining").alias("remaining"))


@query("membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.members(tab(spark, sf_dir, "documents").select("doc_id", "lang"), tab(spark, sf_dir, "labels"), "doc_id")


@query("latest_n", """SELECT id, email, total_amount, rank FROM (SELECT o_orderkey AS id, CAST(o_custkey AS varchar) AS email, o_totalprice AS total_amount,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC) AS integer) AS rank FROM orders) WHERE rank <= 10""")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_each(orders(spark, sf_dir), 10).select("id", "email", "total_amount", "rank")


@query("latest_of_user", """SELECT o_orderkey AS id, o_totalprice AS total_amount FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey DESC LIMIT 10""")
def latest_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    least = tab(spark, sf_dir, "orders").agg(F.min("o_custkey").cast("string")).first()[0]
    return store.latest(o, least, 10).select("id", "total_amount")


@query("first_ten", """SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('second', o_orderdate), o_orderkey) <= 10 AS can_download_xml FROM orders""")
def first_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_ten(orders(spark, sf_dir)).select("id", "can_download_xml")


@query("lookup_by_id", "SELECT o_orderkey AS id, o_totalprice AS total_amount FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = tab(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return store.by_id(orders(spark, sf_dir), str(most)).select("id", "total_amount")


@query("usage_lookup", "SELECT coalesce(max(n), 0) AS usage_count FROM (SELECT count(*) AS n FROM events WHERE user_id = 7)")
def usage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = tab(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("email")).agg(F.count(F.lit(1)).alias("usage_count"))
    return store.usage_of(usage, "7")


@query("history_insert", INVOICES + "SELECT CAST(cust AS varchar) AS email, concat('INV-', CAST(doc_id AS varchar)) AS invoice_no, CAST(amount AS double) AS total_amount, CAST(cgst + sgst + igst AS double) AS gst_amount FROM checked")
def history_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(rendered(spark, sf_dir), strict=True, only=HISTORY)
    rows = store.history_rows(got, F.col("cust").cast("string"), F.lit(None).cast("string"), R.status(F.col("invoice")))
    return rows.select("email", "invoice_no", "total_amount", "gst_amount")


@query("expired_files", "SELECT event_id FROM events WHERE date_diff('second', ts, (SELECT max(ts) FROM events)) > 86400")
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tab(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("modificationTime"))
    now = e.agg(F.max("modificationTime")).first()[0]
    return store.expired(e, F.lit(now)).select("event_id")


# --------------------------------------------------------------------- reports


@query("report_rows", INVOICES + """SELECT doc_id, 'Purchase' AS voucher_type, substr(text, strpos(text, 'DATE: ') + 12, 4) || '-' || substr(text, strpos(text, 'DATE: ') + 9, 2) || '-' || substr(text, strpos(text, 'DATE: ') + 6, 2) AS date,
  CAST(sub AS double) AS taxable, CAST(cgst AS double) AS cgst, CAST(sgst AS double) AS sgst, CAST(igst AS double) AS igst, CAST(amount AS double) AS total FROM checked""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(rendered(spark, sf_dir), strict=True, only=SHEET)
    rows = reports.sheet_rows(got.withColumn("n", F.col("doc_id")), F.col("doc_id").cast("string"), F.lit("a/b.pdf"))
    return rows.select(F.col("Validation Status").cast("long").alias("doc_id"), F.col("Voucher Type").alias("voucher_type"), F.col("Date").alias("date"), F.col("Taxable Value").alias("taxable"), F.col("CGST").alias("cgst"), F.col("SGST").alias("sgst"), F.col("IGST").alias("igst"), F.col("Total Amount").alias("total"))


@query("batch_rows", INVOICES + """SELECT CASE WHEN doc_id % 5 = 0 THEN 'FAILED' WHEN cgst + sgst + igst = 0 THEN 'Non GST Invoice' WHEN abs(amount - expected) > 1 THEN 'REQUIRES MANUAL REVIEW' ELSE 'VALID' END AS status,
  count(*) AS n, CAST(coalesce(sum(CASE WHEN doc_id % 5 <> 0 THEN cgst + sgst + igst END), 0) AS double) AS gst, CAST(sum(CASE WHEN doc_id % 5 <> 0 THEN amount END) AS double) AS total FROM checked GROUP BY 1""")
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk rows with failures in their own rows, their summary, and its totals by status."""
    got = extract(rendered(spark, sf_dir), strict=True, only=[*SHEET, "rules_applied"]).withColumn("error", F.when(F.col("doc_id") % 5 == 0, "no text"))
    bulk = reports.bulk_rows(got, F.col("doc_id").cast("string"), R.status(F.col("invoice")), F.col("error"), F.lit("out"))
    s = reports.batch_summary(bulk)
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return s.groupBy(F.col("Validation Status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(money("GST"), F.lit(0.0)).alias("gst"), money("Total").alias("total"))


@query("bulk_sheet", INVOICES + """,
conf AS (SELECT *, CASE WHEN NOT halves THEN 0.7 WHEN cgst = 0 THEN 0.9 ELSE 0.97 END + CASE WHEN NOT halves THEN 0.7 WHEN sgst = 0 THEN 0.9 ELSE 0.97 END + CASE WHEN halves THEN 0.7 ELSE 0.9 END AS taxes, CAST(cgst <> 0 AND sgst <> 0 AS integer) AS whole FROM checked)
SELECT concat(CAST(doc_id AS varchar), '.pdf') AS source, CAST(strptime(substr(text, strpos(text, 'DATE: ') + 6, 10), '%d-%m-%Y') AS date) AS date, CAST(cgst + sgst + igst AS double) AS gst,
  CAST(round(100 * (0.99 + 0.95 + 0.9 + 0.9 + taxes + 0.95 * whole) / (7 + whole), 2) AS double) AS score,
  concat_ws(', ', 'INVOICE_NUMBER_LABEL_PRIORITY', CASE WHEN halves THEN 'CGST_MULTI_LINE_SUM, SGST_MULTI_LINE_SUM' END, CASE WHEN whole = 1 THEN 'TOTAL_TAX_FROM_9_PERCENT_COMPONENTS' END, 'GRAND_TOTAL_PRIORITY, MATH_VALIDATION, TOTAL_BLOCK_PRIORITY, WORDS_TOTAL_MATCH') AS rules FROM conf""")
def bulk_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk rows with their rule lists, and their summary with dates and mean confidences."""
    got = extract(rendered(spark, sf_dir), strict=True, only=[*SHEET, "rules_applied"])
    bulk = reports.bulk_rows(got, F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), R.status(F.col("invoice")), F.lit(None).cast("string"), F.lit("out"))
    s = reports.batch_summary(bulk, "Rules Applied")
    return s.select(*[F.col(c).alias(n) for c, n in (("Source File Name", "source"), ("Date", "date"), ("GST", "gst"), ("Confidence Score", "score"), ("Rules Applied", "rules"))])


@query("date_formats", """
WITH d AS (SELECT o_orderkey, o_orderdate, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 5 AND day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normalized,
  CASE WHEN k = 3 THEN strftime(o_orderdate, '%d%m%Y') WHEN k = 5 AND day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y%m%d') WHEN k = 5 THEN strftime(o_orderdate, '%m%d%Y')
    ELSE strftime(o_orderdate, '%Y%m%d') END AS voucher FROM d""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six forms of a date; one with the month first is read so only where no day-first reading fits."""
    k = F.col("o_orderkey") % 6
    shown = F.lit("")
    for i, f in enumerate(["dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd-MMM-yyyy", "MM/dd/yyyy"]):
        shown = F.when(k == i, F.upper(F.date_format("o_orderdate", f))).otherwise(shown)
    return tab(spark, sf_dir, "orders").select("o_orderkey", D.normalized_date(shown).alias("normalized"), D.voucher_date(shown).alias("voucher"))


@query("license_states", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'License invalid – machine mismatch' WHEN date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS date)) < 0 THEN 'License expired. Please renew.'
  WHEN date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS date)) <= 3 THEN concat('License will expire in ', CAST(date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS date)) AS varchar), ' day(s). Please renew soon.') ELSE 'License valid' END AS message FROM orders""")
def license_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = F.when(F.col("o_orderkey") % 4 == 0, "other").otherwise("this")
    state = D.license_state(machine, F.lit("this"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1996-01-01").cast("date"))
    return tab(spark, sf_dir, "orders").select("o_orderkey", state["message"].alias("message"))


@query("report_unpivot", "SELECT p_partkey, 'p_name' AS Field, p_name AS Value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS varchar) FROM part")
def report_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.field_values(tab(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_brand", "p_size"])


@query("column_widths", "SELECT greatest(max(length(p_name)), 6) AS p_name, greatest(max(length(p_brand)), 7) AS p_brand FROM part")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reports.column_widths(tab(spark, sf_dir, "part").select("p_name", "p_brand"))
    return w.select(*[F.col(c).cast("long").alias(c) for c in w.columns])


@query("vouchers", INVOICES + """SELECT doc_id, 2 + CAST(cgst <> 0 AS integer) + CAST(sgst <> 0 AS integer) + CAST(igst <> 0 AS integer) AS entries, concat('-', CAST(amount AS varchar)) AS debtors,
  substr(text, strpos(text, 'DATE: ') + 12, 4) || substr(text, strpos(text, 'DATE: ') + 9, 2) || substr(text, strpos(text, 'DATE: ') + 6, 2) AS date FROM checked""")
def vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voucher documents, read back by their tags."""
    d = extract(rendered(spark, sf_dir), strict=True, only=[*AMOUNTS, "invoice_number", "invoice_date"]).select("doc_id", reports.voucher_xml(F.col("invoice")).alias("xml"))
    return d.select("doc_id", F.regexp_count("xml", F.lit("<ALLLEDGERENTRIES.LIST>")).alias("entries"), F.regexp_extract("xml", "<AMOUNT>([^<]*)", 1).alias("debtors"), F.regexp_extract("xml", "<DATE>([^<]*)", 1).alias("date"))

