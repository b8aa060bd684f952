"""What a rule makes once is not made again for each element: plans of the rules, and their values on odd inputs."""

from pyspark.sql import functions as F

from vouchlake.functions import amounts as A
from vouchlake.functions import text as T
from vouchlake.operators import extraction as X
from vouchlake.plans import field_queries as _field_queries  # noqa: F401  registers the queries
from vouchlake.plans import registry


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_number_words_are_looked_up_by_checksum(spark):
    texts = {"": None, "RUPEES ONLY": None, "zero": 0, "Hundred": 100, "lakh": 100_000, "twenty-one crore, and two": 210_000_002, "ONE HUNDRED TWO HUNDRED": 10_200, "THOUSAND THOUSAND": 2_000, "ONEHUNDRED": None, "five é six": 11}
    d = spark.createDataFrame([*texts.items(), (None, None)], "t string, want long").select("t", "want", T.words_to_number(F.col("t")).alias("got"))
    assert all(x["got"] == x["want"] for x in d.collect())
    assert "map(" not in plan(d) and "keys: " not in plan(d)  # no search through a map's keys for each token


def test_an_identifier_is_stripped_once(spark):
    d = spark.createDataFrame([("27AAPFU0939F1ZV", True), (" 27aapfu0939f1zv\n", True), ("27AAPFU0939F1ZW", False), ("27AAPFU0939F1Z", False), ("", False), (None, False)], "g string, want boolean")
    d = d.select("want", T.gstin_valid(F.col("g")).alias("got"))
    assert all(x["got"] == x["want"] for x in d.collect())
    assert plan(d).count("regexp_replace") == 1


def test_item_rows_make_each_text_once(spark):
    d = spark.createDataFrame([("DESC\nITEM p1  -12.50\n\x1c 8471: 5 : \nITEM\tA 1,200.00 B",)], "t string").select(F.explode(F.expr(X.items(f"({A.analyzed('t')})"))).alias("i")).select("i.*")
    assert [(x[0], x[1], str(x[2])) for x in d.collect()] == [(None, "ITEM p1", "12.50"), ("8471", None, "5.00"), (None, "ITEM A B", "1200.00")]
    once = spark.createDataFrame([([],)], f"L array<struct<line string, amts array<{A.MONEY}>>>").select(F.expr(X.items("L")).alias("v"))
    assert plan(once).count("regexp_replace") == 2 and plan(once).count("regexp_extract(") == 1


def test_tax_tables_read_no_amounts_of_their_own(spark):
    d = registry.QUERIES["tax_table"](spark, "/root/testdata/sf0.001")
    assert A.AMOUNT not in plan(d) and d.where("igst is not null").count() > 100
