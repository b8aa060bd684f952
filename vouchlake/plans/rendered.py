"""Invoice texts rendered from orders and their lines, as DataFrame and as SQL: inputs for the extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same statement on both engines: exact decimals, lines in a fixed order.
RENDERED = """
WITH line AS (
  SELECT l_orderkey, l_partkey,
    CAST(round(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(4,2))), 2) AS decimal(14,2)) AS net,
    CAST(l_tax AS decimal(4,2)) AS rate
  FROM lineitem),
taxed AS (SELECT l_orderkey, l_partkey, net, CAST(round(net * rate, 2) AS decimal(14,2)) AS tax FROM line),
per_order AS (
  SELECT l_orderkey, CAST(sum(net) AS decimal(16,2)) AS net, CAST(sum(tax) AS decimal(16,2)) AS tax, {rows} AS item_rows
  FROM taxed GROUP BY l_orderkey),
halves AS (SELECT *, CAST(tax * CAST(0.5 AS decimal(2,1)) AS decimal(16,2)) AS half FROM per_order)
SELECT o_orderkey AS doc_id, o_custkey AS cust,
  concat('TAX INVOICE', chr(10), 'INVOICE NUMBER: INV-', CAST(o_orderkey AS {string}), chr(10), 'INVOICE DATE: ', {date}, chr(10),
    'DESCRIPTION RATE AMOUNT', chr(10), item_rows, chr(10), 'SUB TOTAL ', CAST(net AS {string}), chr(10),
    CASE WHEN o_orderkey % 2 = 0 THEN concat('CGST ', CAST(half AS {string}), chr(10), 'SGST ', CAST(CAST(tax - half AS decimal(16,2)) AS {string}))
      ELSE concat('IGST ', CAST(tax AS {string})) END, chr(10),
    'GRAND TOTAL ', CAST(CAST(net + tax + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS decimal(16,2)) AS {string})) AS text
FROM orders JOIN halves ON o_orderkey = l_orderkey
"""
SPARK = RENDERED.format(
    rows="array_join(transform(sort_array(collect_list(struct(l_partkey, net))), x -> concat('ITEM p', cast(x.l_partkey AS string), ' ', cast(x.net AS string))), chr(10))",
    string="string",
    date="date_format(o_orderdate, 'dd-MM-yyyy')",
)
DUCK = RENDERED.format(
    rows="string_agg(concat('ITEM p', CAST(l_partkey AS varchar), ' ', CAST(net AS varchar)), chr(10) ORDER BY l_partkey, net)",
    string="varchar",
    date="strftime(o_orderdate, '%d-%m-%Y')",
)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, cust, text: one invoice for each order with lines. Every seventh total is off by three."""
    of = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    # Dealt by order once, to a stated number of tasks: texts are small but costly to read, and would be merged into one.
    of["lineitem"] = of["lineitem"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return spark.sql(SPARK.replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}"), **of)
