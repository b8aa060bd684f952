"""Queries of single extraction rules over texts built from the tables, each with SQL that reads the same texts another way.

A text is one SQL expression for both engines ({string} is the type's name); the SQL finds by patterns or by the
columns that the text was built from what the rule has to find in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import text as T
from ..operators import extraction as X
from ..operators import reconcile as R
from ..operators import reports
from ..sources import archives
from ..sources import documents as S
from ..sources.shared import new_folder
from .registry import query

MONEY = A.MONEY
N = "chr(10)"


def built(spark: SparkSession, sf_dir: str, table: str, columns: str, text: str) -> DataFrame:
    """columns, text and its lines L."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns.split("; "), f"{text.format(string='string')} AS text")
    return rows.withColumn("L", F.expr(A.analyzed("text")))


def sql(table: str, columns: str, text: str, select: str) -> str:
    return f"WITH t AS (SELECT {columns.replace('; ', ', ')}, {text.format(string='varchar')} AS text FROM {table})\n{select}"


def doubled(**columns: str) -> list:
    return [F.expr(c).cast("double").alias(n) for n, c in columns.items()]


ORDER = "o_orderkey AS k; CAST(o_totalprice AS decimal(18,2)) AS price; o_orderdate AS day"
PRICE = "CAST(CAST(o_totalprice AS decimal(18,2)) AS {string})"
KEY = "CAST(o_orderkey AS {string})"

# --------------------------------------------------------------------- numbers and dates

NUMBERS = f"""concat('HEAD', {N}, CASE o_orderkey % 8 WHEN 0 THEN concat('PI NO: PI/', {KEY}) WHEN 1 THEN concat('ESTIMATION NO - E', {KEY}) WHEN 2 THEN concat('INVOICE NUMBER: INV-', {KEY})
  WHEN 3 THEN concat('BILL NO. ', {KEY}) WHEN 4 THEN concat('INVOICE NUMBER: LUT', {KEY}) WHEN 5 THEN concat('REF ', CAST(1000 + o_orderkey % 9000 AS {{string}}), '/22-23') WHEN 6 THEN 'INVOICE DATE MISSING'
  ELSE 'INVOICE NO: ABC' END, {N}, 'END')"""


@query("number_rules", sql("orders", ORDER, NUMBERS, r"""
SELECT k, coalesce(nullif(regexp_extract(text, 'PI NO: (PI/[0-9]+)', 1), ''), nullif(regexp_extract(text, 'ESTIMATION NO - (E[0-9]+)', 1), ''), nullif(regexp_extract(text, 'INVOICE NUMBER: (INV-[0-9]+)', 1), ''), nullif(regexp_extract(text, 'BILL NO\. ([0-9]+)', 1), '')) AS priority,
  coalesce(CASE WHEN text LIKE '%INVOICE NUMBER: INV-%' THEN regexp_extract(text, 'INV-[0-9]+') END, nullif(regexp_extract(text, 'BILL NO\. ([0-9]{2,})', 1), ''), nullif(regexp_extract(text, '[0-9]{4}/22-23'), '')) AS fallback,
  CASE WHEN text LIKE '%INVOICE %' THEN regexp_extract(text, 'INVOICE (NUMBER: |NO: )?([A-Z0-9-]+)', 2) END AS engine FROM t"""))
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice numbers by priority label, by fallback and by the checking engine; other registrations are refused."""
    d = built(spark, sf_dir, "orders", ORDER, NUMBERS)
    return d.select("k", F.expr(X.invoice_number("text")).alias("priority"), F.expr(X.invoice_number_fallback("text")).alias("fallback"), F.expr(X.trimmed(X.found("text", X.ENGINE_NUMBER))).alias("engine"))


DAY = {"string": ("date_format(o_orderdate, '{}')", "dd-MM-yyyy", "d/M/yy", "dd MMM yyyy", "dd-MMM-yyyy"), "varchar": ("strftime(o_orderdate, '{}')", "%d-%m-%Y", "%-d/%-m/%y", "%d %b %Y", "%d-%b-%Y")}


def dated(kind: str) -> str:
    call, *forms = DAY[kind]
    one, two, three, four = (f"upper({call.format(f)})" for f in forms)
    return f"""CASE o_orderkey % 7 WHEN 0 THEN concat('PI DATE: ', {one}) WHEN 1 THEN concat('DATE ', {two}) WHEN 2 THEN concat('ON ', {three}) WHEN 3 THEN concat('ON ', {four})
  WHEN 4 THEN concat('PRICE IS VALID TILL ', {one}, {N}, 'INVOICE DATE: ', {two}) WHEN 5 THEN concat('WARRANTY ', {one}) ELSE concat('BILL OF ', {two}, {N}, 'ORDER REF DATE - ', {one}) END"""


@query("date_rules", sql("orders", ORDER, dated("varchar"), r"""
SELECT k, CASE WHEN k % 7 IN (0, 6) THEN nullif(regexp_extract(text, '(?:PI DATE: |ORDER REF DATE - )([0-9]{2}-[0-9]{2}-[0-9]{4})', 1), '') END AS priority,
  CASE WHEN k % 7 = 5 THEN NULL WHEN k % 7 = 4 THEN regexp_extract(text, 'INVOICE DATE: (.*)$', 1) ELSE regexp_extract(text, '^(?:PI DATE: |DATE |ON |BILL OF )([^\n]*)', 1) END AS any_date,
  CASE WHEN k % 7 = 4 THEN regexp_extract(text, 'INVOICE DATE: (.*)$', 1) END AS engine FROM t"""))
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by priority label, any date, and the checking engine's; offers and warranties hold none."""
    d = built(spark, sf_dir, "orders", ORDER, dated("string"))
    return d.select("k", F.expr(X.priority_date("L")).alias("priority"), F.expr(X.any_date("L")).alias("any_date"), F.expr(X.found("text", X.ENGINE_DATE)).alias("engine"))


GSTINS = "concat(CASE WHEN c_custkey % 3 = 0 THEN 'GSTIN: ' ELSE 'OUR ' END, lpad(CAST(c_custkey % 37 AS {string}), 2, '0'), 'ABCDE', lpad(CAST(c_custkey % 10000 AS {string}), 4, '0'), 'F1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 36 AS int) + 1, 1), ' END')"


@query("gstin_rules", sql("customer", "c_custkey AS k", GSTINS, """,
g AS (SELECT k, text, regexp_extract(text, '[0-9]{2}ABCDE[0-9]{4}F1Z[0-9A-Z]') AS g FROM t),
p AS (SELECT *, list_transform(range(1, 15), lambda i: (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(g, CAST(i AS bigint), 1)) - 1) * (2 - i % 2)) AS ps FROM g)
SELECT k, CASE WHEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - list_sum(list_transform(ps, lambda x: x // 36 + x % 36)) % 36) % 36 AS bigint) + 1, 1) = substr(g, 15, 1) THEN g END AS gstin,
  CASE WHEN text LIKE 'GSTIN: %' THEN g END AS engine FROM p"""))
def gstin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier by its form and check character, and the labelled one, unchecked."""
    d = built(spark, sf_dir, "customer", "c_custkey AS k", GSTINS).withColumn("g", F.expr(X.gstin("text")))
    return d.select("k", F.when(T.gstin_valid(F.col("g")), F.col("g")).alias("gstin"), F.expr(X.found("text", X.ENGINE_GSTIN)).alias("engine"))


# --------------------------------------------------------------------- amounts

WHOLE = "CAST(CAST(floor(o_totalprice) AS bigint) AS {string})"
SUSPECTS = f"""CASE o_orderkey % 8 WHEN 0 THEN concat('HSN ', {WHOLE}) WHEN 1 THEN concat('BOLT ', {WHOLE}, ' NOS ', {PRICE}) WHEN 2 THEN concat('PIN ', {WHOLE}) WHEN 3 THEN concat('SHIPPING TO CHENNAI ', {WHOLE})
  WHEN 4 THEN concat('FEE ', {WHOLE}) WHEN 5 THEN concat(CAST(o_orderkey AS {{string}}), ' PCS') WHEN 6 THEN concat('SACK ', {WHOLE}) ELSE concat(CAST(o_orderkey % 90 + 1 AS {{string}}), ',', lpad(CAST(o_orderkey % 1000 AS {{string}}), 3, '0'), '.50') END"""


@query("amount_filters", sql("orders", ORDER, SUSPECTS, """
SELECT k, CASE WHEN kept THEN CAST(value AS double) END AS amount, CAST(kept AS integer) AS n FROM (
  SELECT k, CASE WHEN k % 8 = 7 THEN CAST(replace(text, ',', '') AS decimal(18,2)) WHEN k % 8 = 1 THEN price ELSE floor(price) END AS value,
    CASE k % 8 WHEN 0 THEN length(CAST(CAST(floor(price) AS bigint) AS varchar)) NOT BETWEEN 4 AND 8 WHEN 2 THEN length(CAST(CAST(floor(price) AS bigint) AS varchar)) <> 6
      WHEN 3 THEN length(CAST(CAST(floor(price) AS bigint) AS varchar)) <> 6 WHEN 5 THEN false ELSE true END AS kept FROM t)"""))
def amount_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of lines in which counts, product codes and postal codes stand."""
    d = built(spark, sf_dir, "orders", ORDER, SUSPECTS)
    return d.select("k", F.expr(A.last("L[0].amts")).cast("double").alias("amount"), F.expr("size(L[0].amts)").alias("n"))


VALUES = f"""concat('TOTAL ORDER VALUE (EXCLUDING TAX) ', {PRICE}, {N}, 'NET AMOUNT', CASE WHEN o_orderkey % 2 = 0 THEN {N} ELSE ' ' END, CAST(o_orderkey AS {{string}}), '.25', {N}, 'FREIGHT CHARGES',
  CASE WHEN o_orderkey % 3 = 0 THEN {N} ELSE ' ' END, CAST(o_orderkey % 500 AS {{string}}), '.75', {N}, 'ROUND OFF ', CASE WHEN o_orderkey % 5 = 0 THEN '- 0.40' ELSE concat('-0.', CAST(10 + o_orderkey % 90 AS {{string}})) END, {N}, 'TAXABLE VALUE ', {PRICE})"""


@query("value_rules", sql("orders", ORDER, VALUES, """
SELECT k, CAST(price AS double) AS order_value, k + 0.25::double AS net, CASE WHEN k % 3 <> 0 THEN k % 500 + 0.75::double END AS freight,
  CASE WHEN k % 5 = 0 THEN 0.4::double ELSE CAST(CAST(regexp_extract(text, 'ROUND OFF (-0.[0-9]+)', 1) AS decimal(18,2)) AS double) END AS round_off,
  CASE WHEN k % 2 = 0 THEN k + 0.25::double ELSE k + 0.25::double END AS subtotal FROM t"""))
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value, net amount (in its line or the next), freight (in its line only), signed round-off, and the sub total by pattern."""
    d = built(spark, sf_dir, "orders", ORDER, VALUES)
    subtotal = A.money(X.found("text", X.SUBTOTAL))
    return d.select("k", *doubled(order_value=A.labelled("L", X.ORDER_VALUE_LABELS), net=A.labelled("L", ["NET AMOUNT"]), freight=A.labelled_here("L", ["FREIGHT"]), round_off=A.round_off("L"), subtotal=subtotal))


SMALL = "CASE o_orderkey % 9 WHEN 0 THEN 'ONE' WHEN 1 THEN 'TWO' WHEN 2 THEN 'THREE' WHEN 3 THEN 'FOUR' WHEN 4 THEN 'FIVE' WHEN 5 THEN 'SIX' WHEN 6 THEN 'SEVEN' WHEN 7 THEN 'EIGHT' ELSE 'NINE' END"
SPELLED = f"concat({SMALL}, ' LAKH FORTY-FIVE THOUSAND ', {SMALL}, ' HUNDRED AND TWELVE RUPEES ONLY')"
WORDS = f"""CASE o_orderkey % 7 WHEN 0 THEN concat('TOTAL INVOICE VALUE (IN WORDS) ', {SPELLED}) WHEN 1 THEN concat('TOTAL IN WORDS', {N}, {SPELLED}) WHEN 2 THEN concat('AMOUNT IN WORDS: ', {SPELLED})
  WHEN 3 THEN concat('AMOUNT IN WORDS', {N}, {SPELLED}) WHEN 4 THEN concat('AMOUNT CHARGEABLE (IN WORDS) : ', {SPELLED}) WHEN 5 THEN concat('AMOUNT CHARGEABLE (IN WORDS)', {N}, {SPELLED}) ELSE concat('SAY ', {SPELLED}) END"""


@query("word_totals", sql("orders", ORDER, WORDS, "SELECT k, CASE WHEN k % 7 < 6 THEN (k % 9 + 1) * 100000 + 45000 + (k % 9 + 1) * 100 + 12::double END AS words FROM t"))
def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in words by all four readings, in the label's line or the next."""
    d = built(spark, sf_dir, "orders", ORDER, WORDS).select("k", F.expr(X.word_readings("text", "L")).alias("readings"))
    return d.select("k", X.amount_in_words(F.col("readings")).cast("double").alias("words"))


TABLE = """
WITH line AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(round(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(4,2))), 2) AS decimal(14,2)) AS net, CAST(100 * l_tax AS int) AS rate FROM lineitem),
taxed AS (SELECT k, p, net, rate, CAST(round(net * CAST(rate AS decimal(4,0)) * CAST(0.01 AS decimal(3,2)), 2) AS decimal(14,2)) AS tax FROM line),
whole AS (SELECT k, CAST(sum(net) AS decimal(18,2)) AS net, CAST(sum(tax) AS decimal(18,2)) AS tax, CAST(sum(rate) AS bigint) AS rates, count(*) AS n, {rows} AS item_rows FROM taxed GROUP BY k),
t AS (SELECT *, concat('HSN/SAC TAXABLE VALUE IGST', chr(10), item_rows, chr(10), CASE WHEN k % 2 = 0 THEN concat('TOTAL ', CAST(net AS {string}), ' ', CAST(tax AS {string})) ELSE 'END' END) AS text FROM whole)
"""
TABLE_SPARK = TABLE.format(string="string", rows="array_join(transform(sort_array(collect_list(struct(p, net, rate, tax))), x -> concat(string(1000 + x.p % 9000), ' ', string(x.net), ' ', string(x.rate), '% ', string(x.tax))), chr(10))")
TABLE_DUCK = TABLE.format(string="varchar", rows="string_agg(concat(CAST(1000 + p % 9000 AS varchar), ' ', CAST(net AS varchar), ' ', CAST(rate AS varchar), '% ', CAST(tax AS varchar)), chr(10) ORDER BY p, net, rate, tax)")


@query("tax_table", TABLE_DUCK + "SELECT k, CASE WHEN k % 2 = 0 THEN CAST(net AS double) END AS taxable, CASE WHEN k % 2 = 0 THEN CAST(tax AS double) END AS tax, CAST(net AS double) AS line_taxable, CAST(tax + rates AS double) AS line_tax, CAST(tax AS double) AS igst FROM t")
def tax_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-code tax tables: the total row's values, the sums of the rows (rates count as numbers), the inter-state sum."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = spark.sql((TABLE_SPARK + "SELECT k, text FROM t").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem).select("k", F.expr("transform(split(text, '\\n', -1), line -> named_struct('line', line))").alias("L"))
    return d.select("k", F.expr(X.tax_summary("L")).alias("s")).select("k", *doubled(taxable="s.taxable", tax="s.tax", line_taxable="s.line_taxable", line_tax="s.line_tax", igst="s.igst"))


TAXES = f"""CASE o_orderkey % 5 WHEN 0 THEN concat('RATE      TAX AMOUNT CGST', {N}, '9.00      ', {PRICE}) WHEN 1 THEN concat('CGST 9%', {N}, 'AND', {N}, {PRICE}) WHEN 2 THEN concat('9 % CGST ', {PRICE})
  WHEN 3 THEN concat('CGST @ ', {PRICE}) ELSE concat('CGST NONE', {N}, 'X') END"""


@query("tax_places", sql("orders", ORDER, TAXES, """
SELECT k, CASE WHEN k % 5 = 1 THEN 9 WHEN k % 5 < 4 THEN CAST(price AS double) END AS by_column, CASE k % 5 WHEN 1 THEN CAST(price AS double) WHEN 2 THEN CAST(price AS double) END AS near_label,
  CASE WHEN k % 5 < 4 THEN CAST(price AS double) END AS by_rate, CASE k % 5 WHEN 2 THEN CAST(price AS double) WHEN 3 THEN CAST(price AS double) END AS by_line FROM t"""))
def tax_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tax in a TAX AMOUNT column, near its label, at nine per cent, and in its line."""
    d = built(spark, sf_dir, "orders", ORDER, TAXES)
    near = A.near_label_tax("L", r"(?:9\s*%\s*CGST|CGST\s*[:\-]?\s*9\s*%)")
    return d.select("k", *doubled(by_column=A.column_tax("L", "CGST"), near_label=near, by_rate=A.rate_tax("L", "CGST"), by_line=X.line_tax("L", "CGST")))


BLOCKS = f"""concat('HEAD', {N}, CASE WHEN o_orderkey % 2 = 0 THEN concat('DESCRIPTION QTY AMOUNT', {N}, 'BOLT ', {PRICE}, {N}) ELSE '' END, CASE WHEN o_orderkey % 3 > 0 THEN concat('CGST 10.00', {N}, 'CGST ', CAST(o_orderkey % 100 AS {{string}}), '.50', {N}, 'TOTAL CGST 99.00', {N}) ELSE '' END,
  CASE WHEN o_orderkey % 5 > 0 THEN concat('SUB TOTAL ', {PRICE}, {N}, 'ROUND OFF 0.25', {N}, 'NET PAYABLE ', {PRICE}) ELSE 'THANKS' END)"""


@query("section_rules", sql("orders", ORDER, BLOCKS, """,
n AS (SELECT *, k % 2 = 0 AS has_item, k % 3 > 0 AS has_tax, k % 5 > 0 AS has_total FROM t),
spots AS (SELECT *, CASE WHEN has_item THEN 2 END AS item, CASE WHEN has_tax THEN 2 + 2 * has_item::int END AS tax FROM n),
-- A block of totals may begin at the total of a tax, where there are taxes, or at the sub total.
more AS (SELECT *, CASE WHEN has_tax THEN tax + 2 WHEN has_total THEN 2 + 2 * has_item::int END AS total FROM spots)
SELECT k, item, tax, total, CASE WHEN has_tax THEN 10.0::double + k % 100 + 0.5 END AS block_cgst,
  CASE WHEN has_total THEN CAST(price AS double) END AS block_taxable, CASE WHEN has_tax THEN 99.0::double WHEN has_total THEN CAST(price AS double) END AS block_final, CASE WHEN has_total THEN 0.25::double END AS block_round_off,
  CASE WHEN has_item THEN 1 ELSE 0 END AS n_items FROM more"""))
def section_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item, tax and total blocks: where they begin, and what they hold."""
    d = built(spark, sf_dir, "orders", ORDER, BLOCKS).withColumn("at", F.expr(X.sections("L")))
    d = d.select("k", "at", F.expr(X.block("L", "at.tax", "at.total")).alias("tax_block"), F.expr(X.block("L", "coalesce(at.tax, at.total)")).alias("total_block"), F.expr(X.items(X.block("L", "at.item", "coalesce(at.tax, at.total)"))).alias("items"))
    values = doubled(block_cgst=A.tax_sum("tax_block", "CGST"), block_taxable=A.labelled("total_block", X.TAXABLE_LABELS), block_final=A.labelled("total_block", X.BLOCK_FINAL_LABELS), block_round_off=A.round_off("total_block"))
    return d.select("k", "at.item", "at.tax", "at.total", *values, F.size("items").alias("n_items"))


FINALS = f"""CASE o_orderkey % 8 WHEN 0 THEN concat('GRAND TOTAL : ', {PRICE}) WHEN 1 THEN concat('AMOUNT PAYABLE ', {PRICE}) WHEN 2 THEN concat('NET PAYABLE ', {PRICE}) WHEN 3 THEN concat('TOTAL ', {PRICE})
  WHEN 4 THEN concat('TOTAL AMOUNT ', {PRICE}) WHEN 5 THEN concat('GRAND TOTAL:', {N}, 'FOR ALL PARTS OF THE WHOLE ORDER ', {PRICE}) WHEN 6 THEN concat('TOTAL : ', {PRICE}) ELSE 'NOTHING' END"""


@query("final_rules", sql("orders", ORDER, FINALS, """
SELECT k, CASE k % 8 WHEN 0 THEN 'GRAND_TOTAL_PRIORITY' WHEN 1 THEN 'AMOUNT_PAYABLE_PRIORITY' WHEN 2 THEN 'NET_PAYABLE_PRIORITY' WHEN 3 THEN 'TOTAL_RUPEE_PRIORITY' WHEN 4 THEN 'TOTAL_AMOUNT_PRIORITY' WHEN 6 THEN 'TOTAL_GENERIC_FALLBACK' END AS rule,
  CASE WHEN k % 8 < 7 THEN CAST(price AS double) END AS amount,
  CASE WHEN k % 8 IN (5, 6) THEN CAST(price AS double) WHEN k % 8 < 7 THEN CASE WHEN price < 1000 THEN CAST(price AS double) ELSE CAST(substr(CAST(price AS varchar), 1, 3) AS double) END END AS compatible FROM t"""))
def final_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of total patterns, the line after a label, the generic total; amounts in the strict and the compatible mode."""
    d = built(spark, sf_dir, "orders", ORDER, FINALS).select("k", F.expr(X.final_ladder("text", "L", strict=True)).alias("s"), F.expr(X.final_ladder("text", "L")).alias("c"))
    return d.select("k", "s.rule", *doubled(amount="s.amount", compatible="c.amount"))


SUMMARY = f"concat('HSN/SAC  TAXABLE VALUE IGST', {N}, '8471 1.00', {N}, CASE WHEN o_orderkey % 4 = 0 THEN 'SUM ' ELSE 'TOTAL ' END, {PRICE}, ' 1,', lpad(CAST(o_orderkey % 1000 AS {{string}}), 3, '0'), '.50', CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ' 7.00' END, {N}, 'END')"


@query("summary_row", sql("orders", ORDER, SUMMARY, "SELECT k, CASE WHEN k % 4 > 1 THEN CAST(price AS double) END AS taxable, CASE WHEN k % 4 > 1 THEN 1000.5::double + k % 1000 END AS tax FROM t"))
def summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total row of a tax table by pattern: three numbers, or none."""
    d = built(spark, sf_dir, "orders", ORDER, SUMMARY).select("k", F.expr(X.summary_row("text")).alias("s"))
    return d.select("k", *doubled(taxable="s.taxable", tax="s.tax"))


RETRY = f"concat('BASIC AMOUNT: ', {PRICE}, {N}, CASE o_orderkey % 3 WHEN 0 THEN 'NET PAYABLE ' WHEN 1 THEN 'TOTAL ' ELSE 'SUM ' END, {PRICE})"
CUT = "CASE WHEN price < 1000 THEN CAST(price AS double) ELSE CAST(substr(CAST(price AS varchar), 1, 3) AS double) END"


@query("retry_amounts", sql("orders", ORDER, RETRY, f"SELECT k, CASE WHEN k % 2 = 0 THEN 5.0::double WHEN k % 3 < 2 THEN {CUT} ELSE 0.0::double END AS final, CASE WHEN k % 5 = 0 THEN 6.0::double ELSE {CUT} END AS taxable FROM t"))
def retry_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing amounts looked for once more: known ones stay, others are found by pattern (cut after three digits, as the patterns do)."""
    d = built(spark, sf_dir, "orders", ORDER, RETRY).selectExpr("k", "text", f"CAST(if(k % 2 = 0, 5, 0) AS {MONEY}) AS f", f"CAST(if(k % 5 = 0, 6, NULL) AS {MONEY}) AS t")
    return d.select("k", F.expr(X.retried_amounts("text", "f", "t")).alias("r")).select("k", *doubled(final="r.final", taxable="r.taxable"))


# --------------------------------------------------------------------- checks and notes


@query("tax_math", """
SELECT o_orderkey, abs(CAST(o_totalprice AS decimal(18,2)) - e) <= 0.01 AS valid, CAST(e AS double) AS expected, CAST(CAST(o_totalprice AS decimal(18,2)) - e AS double) AS difference,
  concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'gst_number' END, CASE WHEN o_totalprice > 0.005 THEN 'taxable_amount' END, CASE WHEN o_totalprice > 0.005 THEN 'final_amount' END) AS notes, o_orderkey % 2 = 1 AND o_orderkey % 4 IN (0, 3) AS non_gst FROM (
  SELECT *, CAST(o_totalprice AS decimal(18,2)) - 3 + CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN CAST(0.01 AS decimal(18,2)) ELSE 0 END AS e FROM orders)""")
def tax_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax check with a total tax, an inter-state tax, both halves or none; and the notes on the fields that were found."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast(MONEY)
    m = lambda c: c.cast(MONEY)
    inv = F.struct(
        m(price - 3).alias("taxable_amount"), m(F.when(k == 0, 3)).alias("total_tax_amount"), m(F.when(k == 1, 2)).alias("igst_amount"), m(F.when(k == 2, 1)).alias("cgst_amount"), m(F.when(k == 2, 2)).alias("sgst_amount"),
        m(F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.01))).alias("round_off"), price.alias("final_amount"), F.when(F.col("o_orderkey") % 2 == 0, "27AAPFU0939F1ZV").otherwise("").alias("gst_number"),
    )
    d = d.select("o_orderkey", inv.alias("inv")).select("o_orderkey", R.tax_math(F.col("inv")).alias("m"), R.audit(F.col("inv")).alias("audit"), R.is_non_gst(F.col("inv.gst_number"), F.col("inv.cgst_amount"), F.col("inv.sgst_amount"), F.col("inv.igst_amount")).alias("non_gst"))
    names = F.filter(F.array(*map(F.lit, R.AUDIT)), lambda n: F.map_contains_key(F.col("audit"), n))
    return d.select("o_orderkey", "m.valid", F.col("m.expected").cast("double").alias("expected"), F.col("m.difference").cast("double").alias("difference"), F.array_join(names, ",").alias("notes"), "non_gst")


@query("confidence_texts", """SELECT p_partkey, concat(CAST(p_size * 2 AS varchar), '%') AS percent, CASE WHEN p_size * 2 >= 95 THEN '✅ High' WHEN p_size * 2 >= 85 THEN '⚠️ Medium' ELSE '❌ Review' END AS label, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS chosen,
  CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_name ELSE 'none' END AS first FROM part""")
def confidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences as percentages and labels, the choice of the model's record where there is one, and of the first value that is there."""
    score = (F.col("p_size") * 2).cast("decimal(5,2)") / 100
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.percent(score).alias("percent"), T.confidence_label(score).alias("label"), R.choose(F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.col("p_brand")).alias("chosen"), T.first_available(F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(""), F.when(F.col("p_size") % 4 == 1, F.col("p_name")), default=F.lit("none")).alias("first"))


@query("other_vouchers", """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS merged_date, concat('Import for invoice I', CAST(o_orderkey AS varchar)) AS narration, concat('-', CAST(p AS varchar)) AS debtors,
  CASE WHEN tax > 0 THEN CAST(tax AS varchar) END AS tax_entry, CAST(CAST(p - tax AS decimal(18,2)) AS varchar) AS simple_sales, strftime(o_orderdate, '%d%m%Y') AS simple_date FROM (
  SELECT *, CAST(o_totalprice AS decimal(18,2)) AS p, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 + 0.5 END AS decimal(18,2)) AS tax FROM orders)""")
def other_vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers with the taxes in one entry, and from a total and a tax alone, read back by their tags."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    tax = F.when(k % 3 == 0, 0).otherwise(k % 100 + 0.5).cast(MONEY)
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    zero = F.lit(0).cast(MONEY)
    inv = F.struct(F.concat(F.lit("I"), k.cast("string")).alias("invoice_number"), day.alias("invoice_date"), F.lit(None).cast("string").alias("gst_number"), price.alias("final_amount"), (price - tax).cast(MONEY).alias("taxable_amount"), tax.alias("cgst_amount"), zero.alias("sgst_amount"), zero.alias("igst_amount"))
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", inv.alias("i"), tax.alias("tax"), price.alias("price"), day.alias("day"))
    d = d.select("o_orderkey", reports.merged_voucher_xml(F.col("i")).alias("m"), reports.simple_voucher_xml(F.lit(""), F.col("day"), F.col("price"), F.col("tax")).alias("s"))
    of = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return d.select(
        "o_orderkey", of("m", "<DATE>([0-9]*)</DATE>").alias("merged_date"), of("m", "<NARRATION>([^<]*)<").alias("narration"), of("m", "<AMOUNT>([^<]*)<").alias("debtors"),
        of("m", "Output GST</LEDGERNAME>.*?<AMOUNT>([^<]*)<").alias("tax_entry"), of("s", "<LEDGERNAME>Sales</LEDGERNAME>.*?<AMOUNT>([^<]*)<").alias("simple_sales"), of("s", "<DATE>([0-9]*)</DATE>").alias("simple_date"),
    )


# --------------------------------------------------------------------- sources


@query("upload_filter", "SELECT page_id, CASE WHEN lower(url) NOT LIKE '%.html' THEN concat('Unsupported file type: ', url) END AS error FROM pages")
def upload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accepted(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", ".html").select("page_id", "error")


STRIPPED = r"regexp_replace(text, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


@query("text_gate", f"SELECT doc_id, CASE WHEN length({STRIPPED}) < 50 THEN 'OCR failed or insufficient text extracted' END AS error FROM documents")
def text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.enough_text(F.col("text")).alias("error"))


@query("adaptive_text", f"SELECT doc_id, CASE WHEN length({STRIPPED}) >= 2000 THEN {STRIPPED} ELSE concat('scan of ', CAST(octet_length(encode(text)) AS varchar)) END AS text FROM documents")
def adaptive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct text where it is long enough, else what the other extractor gives for the bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))
    return S.adaptive_text(docs, S.plain_text, lambda b: f"scan of {len(b)}", least=2000).select("doc_id", "text")


def zipped(contents):
    """Archives of two members each: a.PDF with the content, and notes.txt."""
    import io
    import zipfile

    import pandas as pd

    out = []
    for c in contents:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("in/a.PDF", c)
            z.writestr("notes.txt", "no document")
        out.append(raw.getvalue())
    return pd.Series(out)


@query("archive_scan", "SELECT CAST(page_id AS varchar) AS archive, 'a.PDF' AS name, sha256(html) AS digest, CAST(NULL AS varchar) AS error FROM pages UNION ALL SELECT concat('broken ', CAST(page_id AS varchar)), NULL, NULL, 'File is not a zip file' FROM pages WHERE url LIKE 'http:%'")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ZIP archives, one archive a page; what is no archive gives its error."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    good = pages.select(F.col("page_id").cast("string").alias("path"), F.pandas_udf(zipped, "binary")(F.col("html").cast("binary")).alias("content"))
    bad = pages.where("url LIKE 'http:%'").select(F.concat(F.lit("broken "), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return S.archive_members(good.unionByName(bad)).select("archive", "name", F.sha2("content", 256).alias("digest"), "error")


@query("report_bundle", "SELECT CAST(o_custkey AS varchar) AS archive, concat('invoice_', CAST(o_orderkey AS varchar), '.xlsx') AS name, sha256(concat(CAST(o_orderkey AS varchar), ',', CAST(CAST(o_totalprice AS decimal(18,2)) AS varchar))) AS digest FROM orders")
def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP archive of each customer's reports, and its members read back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = T.xlsx_name(F.concat(F.lit("invoice_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    content = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_totalprice").cast(MONEY).cast("string")).cast("binary")
    archives = S.bundled(o.select(F.col("o_custkey").cast("string").alias("customer"), name.alias("name"), content.alias("content")), "customer")
    members = S.archive_members(archives.withColumnRenamed("customer", "path"), ".xlsx")
    return members.select("archive", "name", F.sha2("content", 256).alias("digest"))


@query("key_values", "SELECT page_id, regexp_extract(url, '^([^=]*)=', 1) AS key, regexp_extract(url, '=(.*)$', 1) AS value FROM pages WHERE url LIKE '%=%'")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_values(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("value")))


@query("counter_rows", "SELECT event_id, 'k' AS email, CAST(json_extract(props, '$.k') AS bigint) AS n FROM events")
def counter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counter_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("value")))


@query("model_records", """SELECT event_id, concat('A', CAST(event_id AS varchar)) AS invoice_number, CASE WHEN event_id % 3 <> 1 THEN CAST(CAST(value AS decimal(18,2)) AS double) END AS taxable, CASE WHEN event_id % 3 <> 1 THEN 0.85 ELSE 0.4 END::double AS confidence, 0.0::double AS cgst
  FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 3 = 2""")
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of a text model's replies: JSON in other text, a null amount, no JSON at all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    amount = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"INR '), F.col("value").cast(MONEY).cast("string"), F.lit('"'))).otherwise('"null"')
    reply = F.when(F.col("event_id") % 3 == 2, "no answer").otherwise(F.concat(F.lit('Sure: {"Invoice Number": "A'), F.col("event_id").cast("string"), F.lit('", "Taxable Amount": '), amount, F.lit("} done")))
    d = S.model_records(e.select("event_id", reply.alias("text")), lambda t: t)
    m = F.col("model")
    return d.select("event_id", m["invoice_number"].alias("invoice_number"), m["taxable_amount"].cast("double").alias("taxable"), m["confidence"]["taxable_amount"].alias("confidence"), m["cgst_amount"].cast("double").alias("cgst"))


@query("archive_ranges", "SELECT concat('a', CAST(page_id % 3 AS varchar), '.zip') AS archive, concat('p', CAST(page_id AS varchar), '.PDF') AS name, sha256(html) AS digest, CAST(NULL AS varchar) AS error FROM pages WHERE html IS NOT NULL")
def archive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of three large ZIP archives of all pages, by the data source: each archive is read in ranges of its members."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null")
    files = pages.select(F.concat(F.lit("a"), F.col("page_id") % 3, F.lit(".zip")).alias("archive"), F.concat(F.lit("p"), F.col("page_id"), F.lit(".PDF")).alias("name"), F.col("html").cast("binary").alias("content"))
    folder = new_folder(spark, "archives")

    def put(rows) -> None:
        for r in rows:
            to, path = archives.opened(f"{folder}/{r['archive']}")
            to.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with to.open_output_stream(path) as out:
                out.write(r["content"])

    S.bundled(files, "archive").foreachPartition(put)
    spark.dataSource.register(archives.ZipMembers)
    members = spark.read.format("zip_members").option("partition_bytes", 200_000).load(folder)
    return members.select("archive", "name", F.sha2("content", 256).alias("digest"), "error")


@query("object_store", "SELECT concat('pages/', CAST(page_id AS varchar)) AS path, CAST(page_id AS varchar) AS name, sha256(html) AS digest FROM pages WHERE html IS NOT NULL")
def object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages put into the store and got back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null")
    name = F.col("page_id").cast("string")
    kept = S.copied(spark, pages.select(F.concat(F.lit("pages/"), name).alias("path"), name.alias("name"), F.col("html").cast("binary").alias("content")), new_folder(spark, "objects"))
    return kept.select("path", "name", F.sha2("content", 256).alias("digest"))


@query("counters_rewritten", "SELECT CAST(user_id AS varchar) AS email, count(*) AS n FROM events GROUP BY 1")
def counters_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's counter written as JSON, twice, and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("email"), "event_id")
    folder = new_folder(spark, "counters")
    for rows in (e.where("event_id % 2 = 0"), e):
        S.write_counters(rows.groupBy("email").agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.schema("email string, n bigint").json(folder)
