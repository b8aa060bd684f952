"""What each order of five filters removes: kept, redundant, unique and shared removals, and Shapley values.

A relational pipeline. Words are exploded and counted by (document, word), then by document, for totals and
distinct words. Documents are dealt by their key once, as texts, and so both counts need no other shuffle: a
text is smaller than the rows of its words. The other flags (upper case, symbols, identical texts, labels) are
rows of a document each and meet the counts in an outer join. Then one aggregation counts, for every part, the
documents of each of the 32 sets of failed filters in conditional columns, by label too; every order and step
is arithmetic on these columns.

A document's key is the digest of its id and text. Rows that repeat a key have their words counted together;
the counts are divided by the number of rows, so each of the rows counts as a document of its own.

Defined results: a null text is empty, a null or empty source is the part '' (empty string), a null id is neither smaller nor
larger than another (its copies all pass E), an id with several label rows has a label where any of them is 1,
and an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
PART_BYTES = 16_000_000
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x.cast("binary")))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and key of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return rows.withColumn("key", _digest(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")))


def word_counts(rows: DataFrame, parts: int) -> DataFrame:
    """key, words and distinct of rows(key, text) that have words. Texts are shuffled once, their words never."""
    dealt = rows.select("key", "text").repartition(parts, "key")
    words = dealt.select("key", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return words.groupBy("key", "word").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("distinct"))


def _firsts(rows: DataFrame) -> DataFrame:
    """digest and least id of every text that several rows have; ids and digests only are shuffled, after each task has met its own copies."""
    found = rows.select(_digest(F.col("text")).alias("digest"), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return found.where("first < last").select("digest", "first")


def _labels(labels: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, failed (the set of failed filters, filter i as bit i), quality and toxic of every row."""
    rows = _rows(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    flags = rows.select("doc_id", "part", "key", _digest(F.col("text")).alias("digest"), (100 * upper > UPPER_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    # Copies of one text are many rows of one digest: they are dealt by document, and the firsts of texts sent to them in as many salted copies.
    salts = 16
    firsts = _firsts(rows).select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    flags = flags.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(firsts, ["digest", "salt"], "left")
    flags = flags.join(_labels(labels), "doc_id", "left")
    every = flags.groupBy("key", "doc_id", "part", "c", "d", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e"), "quality", "toxic").agg(F.count(F.lit(1)).alias("rows"))
    copies = every.groupBy("key").agg(F.sum("rows").alias("of"))
    counted = every.join(copies, "key").join(word_counts(rows, parts), "key", "left")
    words, distinct = F.coalesce(F.col("words") / F.col("of"), F.lit(0)).cast("long"), F.coalesce("distinct", F.lit(0))
    bits = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.col("e")]
    failed = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    own = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return counted.select("doc_id", "part", failed.cast("int").alias("failed"), own("quality"), own("toxic"), "rows")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    found = failures(docs, labels)
    count = lambda m, *also: F.sum(F.when((F.col("failed") == m) & (F.lit(True) if not also else also[0]), F.col("rows")).otherwise(0))
    sets = found.groupBy("part").agg(
        *[count(m).alias(f"n{m}") for m in range(SETS)],
        *[count(m, F.col("quality")).alias(f"g{m}") for m in range(SETS)],
        *[count(m, F.col("toxic")).alias(f"t{m}") for m in range(SETS)],
    )
    sets = sets.select("part", *[F.array(*[f"{x}{m}" for m in range(SETS)]).alias(x) for x in "ngt"])
    steps = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    # A step's filter and those before it, as sets.
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    before = F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> if(i < step, a | shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1), a))")
    each = sets.select("*", F.explode(steps).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    each = each.withColumn("bit", bit).withColumn("before", before)
    total = lambda x, where: F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, m) -> if({where}, a + {x}, a))")
    fails, earlier = "(m & bit) <> 0", "(m & before) <> 0"
    orders = 1
    for i in range(2, len(FILTERS) + 1):
        orders *= i
    return each.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n[m]", f"NOT {fails} AND NOT {earlier}").alias("kept"),
        total("n[m]", f"{fails} AND NOT {earlier}").alias("removed"),
        total("n[m]", f"{fails} AND {earlier}").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        total("g[m]", f"{fails} AND NOT {earlier}").alias("good_lost"),
        total("t[m]", f"{fails} AND NOT {earlier}").alias("toxic_lost"),
        # In orders / size of the set of all orders, the filter is the first of those that a document fails.
        total(f"n[m] * CAST({orders} / bit_count(m) AS bigint)", fails).alias("shapley"),
    )
