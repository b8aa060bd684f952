"""Look-ups over the lines of documents that are larger than a row: a line is a row, in place of an array's element.

Lines are dealt by document and chunk, a chunk being `CHUNK` neighbouring lines, so a document of a million lines is many
tasks. What a look-up sees around a line, one line before and four after, is carried over the borders: the lines at a chunk's edges
are sent to the neighbouring chunk too, as the few values that frames take of them. A frame is a window over the chunk. What a document has of a field is an aggregate of its lines' values,
the first, the last, the sum or the nearest, which meets in each task before it is shuffled. The array forms
are those of `functions.amounts`; both give the same values.

Rows: a key, `n` (the line's number, without gaps) and `line` (normalized). Null lines have no amounts and no labels.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions.text import normalize
from .extraction import TABLE_HEADER, TABLE_LINES, TAX_ANCHORS, tax_summary

CHUNK = 4096
BEFORE, AFTER = 1, 4


def of_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n and line of documents that fit a row."""
    return docs.select(F.col(f"`{key}`").alias(key), F.posexplode(F.split(normalize(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "\n", -1)).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


def of_files(spark: SparkSession, path: str) -> DataFrame:
    """file, n and line of text files of any size: a file's splits are read by many tasks, and number their lines from what the splits before them hold.

    Lines are normalized one by one and empty ones dropped, as the text form does; white space at a file's two ends stays.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__at"), F.explode(F.split(_plain(F.col("value")), "\n")).alias("line"))
    rows = read.where("line <> ''")
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy("file", "__from").orderBy("__at")))
    counts = own.groupBy("file", "__from").agg(F.max("__own").alias("__lines"))
    earlier = Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("file", "__from", F.coalesce(F.sum("__lines").over(earlier), F.lit(0)).alias("__before"))
    return own.join(carried, ["file", "__from"]).select("file", (F.col("__own") + F.col("__before") - 1).alias("n"), "line")


def _plain(line: Column) -> Column:
    """`normalize` of a line, without stripping."""
    x = F.regexp_replace(F.upper(line), "₹|INR|RS\\.?", "")
    x = F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(x, r"[^\x00-\x7F]+", " ")


@dataclass(frozen=True)
class Look:
    """A look-up of a line with a condition (over `line`): the last amounts of itself and of `ahead` lines after it, own first or last of all. A row needs no more of a neighbour than its last amount."""

    here: str
    ahead: int
    own_first: bool

    def value(self) -> Column:
        after = [F.col(f"__last{i}") for i in range(1, self.ahead + 1)]
        return F.coalesce(*([F.col("__last0"), *after] if self.own_first else [*after, F.col("__last0")]))


def labelled(labels: list[str]) -> Look:
    """A line's value for `labelled`: with a label, its last amount, or else the next line's."""
    return Look(A.has_any("line", labels), 1, True)


def near_label_tax(pattern: str) -> Look:
    """A line's value for `near_label_tax`: the last amount of the first of the three lines after it that has one, else its own."""
    return Look(f"line RLIKE {A.quoted(pattern)}", 3, False)


def column_tax(label: str) -> Column:
    """A line's value for `column_tax`: its array form on `L`, the frame from the line on."""
    return F.expr(f"CASE WHEN contains(line, {A.quoted(label)}) THEN {A.column_tax('L', label)} END")


def _chunked(lines: DataFrame, key: str, chunk: int, before: int, after: int, **columns: Column) -> tuple[DataFrame, WindowSpec]:
    """key, n, __own, __chunk and the columns of each line, in its chunk and in those whose frames reach it; and the window of a chunk.

    columns are over `line` and `amts`; they are computed once a line, before it is sent to a neighbouring chunk, and nothing else travels.
    """
    at, place = F.expr(f"n div {chunk}"), F.col("n") % chunk
    # A chunk's first lines are the frame's end of the chunk before, its last ones the start of the next.
    down, up = (place < after) & (at > 0), place >= chunk - before
    homes = F.when(down & up, F.array(at, at - 1, at + 1)).when(down, F.array(at, at - 1)).when(up, F.array(at, at + 1)).otherwise(F.array(at))
    read = lines.select(F.col(f"`{key}`").alias(key), "n", "line", F.expr(A.line_amounts("line", capital=True)).alias("amts"))
    read = read.select(key, "n", at.alias("__own"), homes.alias("__homes"), *[c.alias(n) for n, c in columns.items()])
    return read.withColumn("__chunk", F.explode("__homes")).drop("__homes"), Window.partitionBy(key, "__chunk").orderBy("n")


def framed(lines: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """lines with `L`, their frame as an array of (line, amts): BEFORE lines before (null at a document's start), the line, AFTER lines after it."""
    rows, w = _chunked(lines, key, chunk, BEFORE, AFTER, line=F.col("line"), amts=F.col("amts"))
    x = F.struct("line", "amts")
    L = F.array(*[F.lag(x, b).over(w) for b in range(BEFORE, 0, -1)], x, *[F.lead(x, a).over(w) for a in range(1, AFTER + 1)])
    return rows.withColumn("L", L).where("__chunk = __own").select(key, "n", "line", "amts", "L")


def _first(value: Column) -> Column:
    """A document's first line value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("n")))


def _leads(w: WindowSpec, ahead: int) -> dict[str, Column]:
    return {f"__last{i}": F.lead("__last0", i).over(w) for i in range(1, ahead + 1)}


def fields(lines: DataFrame, key: str, chunk: int = CHUNK, **wanted: Look | Column) -> DataFrame:
    """A row for each document with the first value of each wanted look-up (`labelled`, `column_tax`, `near_label_tax`). Whole lines travel only for `column_tax`."""
    looks = {n: v for n, v in wanted.items() if isinstance(v, Look)}
    ahead = max([AFTER - 1] * (len(looks) < len(wanted)) + [v.ahead for v in looks.values()])
    # A line's list of amounts is made only for look-ups that take it whole.
    last0 = F.expr(A.last("amts") if len(looks) < len(wanted) else A.last_amount("line", capital=True))
    columns = {"__last0": last0, **{f"__here_{n}": F.expr(v.here) for n, v in looks.items()}}
    if len(looks) < len(wanted):
        columns |= {"line": F.col("line"), "amts": F.col("amts")}
    rows, w = _chunked(lines, key, chunk, 0, ahead, **columns)
    frames = _leads(w, max([0, *[v.ahead for v in looks.values()]]))
    if len(looks) < len(wanted):
        x = F.struct("line", "amts")
        frames["L"] = F.array_compact(F.array(x, *[F.lead(x, i).over(w) for i in range(1, AFTER)]))
    own = rows.withColumns(frames).where("__chunk = __own")
    values = {n: F.when(F.col(f"__here_{n}"), v.value()) if isinstance(v, Look) else v for n, v in wanted.items()}
    return own.groupBy(key).agg(*[_first(v).alias(n) for n, v in values.items()])


def _nearest(rows: Column, target: str) -> Column:
    """Of the amounts of the lines around (`rows`, an array of their amounts), the nearest to the target: gap, n, k, v."""
    return F.array_min(F.transform(F.flatten(F.array_compact(rows)), lambda v, k: F.struct(F.abs(v - F.col(target)).alias("gap"), F.col("n").alias("n"), k.alias("k"), v.alias("v"))))


def near_totals(lines: DataFrame, targets: DataFrame, key: str, target: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each document of targets(key, target): the amount nearest to its target beside its total lines, the first of equals."""
    rows, w = _chunked(lines, key, chunk, BEFORE, 1, amts=F.col("amts"), __near=F.expr(f"line RLIKE {A.quoted(A.TOTAL_NEAR)}"))
    f = rows.withColumn("__around", F.array(F.lag("amts").over(w), "amts", F.lead("amts").over(w))).where("__chunk = __own AND __near").select(key, "n", "__around")
    met = f.join(targets.select(key, F.col(target).cast(A.MONEY).alias("__t")), key).where("__t is not null")
    best = met.groupBy(key).agg(F.min(_nearest(F.col("__around"), "__t")).alias("__b"))
    return targets.select(key).join(best, key, "left").select(key, F.col("__b.v").alias("near"))


def expected_totals(lines: DataFrame, key: str, base: Look, *labels: str, chunk: int = CHUNK) -> DataFrame:
    """`fields`, `tax_sums`, `near_totals` and `search_down` against the expected total, in one pass: key, expected (the first base amount and the taxes' sums), near, larger, and the taxes' sums.

    A line is read once. What a document's total is made of are its label, tax and total lines; they alone meet by document, as
    a window that spills, and are held against the total there.
    """
    word, near = F.expr(f"line RLIKE {A.quoted(A.TOTAL_WORD)}"), F.expr(f"line RLIKE {A.quoted(A.TOTAL_NEAR)}")
    taxes = {f"__tax_{x}": F.contains("line", F.lit(x)) for x in labels}
    rows, w = _chunked(lines, key, chunk, BEFORE, max(1, base.ahead), amts=F.col("amts"), __last0=F.expr(A.last("amts")), __base=F.expr(base.here), __word=word, __near=near, __total=F.contains("line", F.lit("TOTAL")), **taxes)
    frames = {"__around": F.array(F.lag("amts").over(w), "amts", F.lead("amts").over(w)), "__first": F.lag("n").over(w).isNull()} | _leads(w, base.ahead)
    # A chunk's first line stays, so that every document has a row.
    told = functools.reduce(lambda p, q: p | q, [F.col(c) for c in ("__first", "__base", "__word", "__near", *taxes)])
    own = rows.withColumns(frames).where("__chunk = __own").where(told)
    doc = Window.partitionBy(key)
    sums = {x: _tax_sum(F.col(f"__tax_{x}"), F.col("__total"), F.col("__last0"), lambda c: c.over(doc)) for x in labels}
    start = F.when(F.col("__base"), base.value())
    known = own.withColumns({"__sub": F.min_by(start, F.when(start.isNotNull(), F.col("n"))).over(doc), **{f"__sum_{x}": c for x, c in sums.items()}})
    zero = F.lit(0).cast(A.MONEY)
    total = functools.reduce(lambda a, x: (a + F.coalesce(f"__sum_{x}", zero)), labels, F.col("__sub")).cast(A.MONEY)
    met = known.withColumn("__t", total)
    over = F.when(F.col("__word"), F.get(F.filter(F.reverse("amts"), lambda v: v > F.col("__t")), F.lit(0)))
    best = F.when(F.col("__near") & F.col("__t").isNotNull(), _nearest(F.col("__around"), "__t"))
    held = met.select(key, "n", "__t", best.alias("__best"), over.alias("__over"), *[f"__sum_{x}" for x in labels])
    got = held.groupBy(key).agg(F.first("__t").alias("expected"), F.min("__best").alias("__b"), F.max_by("__over", F.when(F.col("__over").isNotNull(), F.col("n"))).alias("larger"), *[F.first(f"__sum_{x}").alias(x.lower()) for x in labels])
    return got.select(key, "expected", F.col("__b.v").alias("near"), "larger", *[x.lower() for x in labels])


def _tax_sum(here: Column, total: Column, amount: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    there = here & amount.isNotNull()
    return F.coalesce(over(F.sum(F.when(there & ~total, amount))).cast(A.MONEY), over(F.max(F.when(there & total, amount))))


def tax_sums(lines: DataFrame, key: str, *labels: str) -> DataFrame:
    """A row for each document with the sum of the label's lines' last amounts, or where there is none the most of its TOTAL lines."""
    rows = lines.select(F.col(f"`{key}`").alias(key), "line", F.expr(A.last_amount("line", capital=True)).alias("amount"))
    return rows.groupBy(key).agg(*[_tax_sum(F.contains("line", F.lit(x)), F.contains("line", F.lit("TOTAL")), F.col("amount")).alias(x.lower()) for x in labels])


def search_down(lines: DataFrame, targets: DataFrame, key: str, least: str) -> DataFrame:
    """A row for each document of targets(key, least): from the bottom, right to left, the first amount of a total line over `least`."""
    rows = lines.where(F.col("line").rlike(A.TOTAL_WORD)).select(F.col(f"`{key}`").alias(key), "n", F.posexplode(F.expr(A.line_amounts("line", capital=True))).alias("k", "v"))
    over = rows.join(targets.select(key, F.col(least).cast(A.MONEY).alias("__t")), key).where("v > __t")
    found = over.groupBy(key).agg(F.max_by("v", F.struct("n", "k")).alias("larger"))
    return targets.select(key).join(found, key, "left")


def tax_tables(lines: DataFrame, key: str) -> DataFrame:
    """A row for each document with a product-code tax table: `s`, its summary. Only the table's lines, 45 at most from its first header, meet in a row."""
    header = F.expr(" AND ".join([f"contains(line, {A.quoted(h)})" for h in TABLE_HEADER] + [A.has_any("line", TAX_ANCHORS)]))
    starts = lines.where(header).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min("n").alias("__start"))
    inside = lines.join(starts, F.col(f"`{key}`").eqNullSafe(F.col("__key"))).where((F.col("n") >= F.col("__start")) & (F.col("n") < F.col("__start") + TABLE_LINES))
    table = inside.groupBy(F.col(f"`{key}`").alias(key)).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("__rows"))
    L = table.select(key, F.expr(f"transform(__rows, z -> named_struct('line', z.line, 'amts', CAST(array() AS array<{A.MONEY}>)))").alias("__L"))
    return L.select(key, F.expr(tax_summary("__L")).alias("s"))
