"""Benchmark decontamination on a distributed positional inverted index, with DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lowered. A window is `width`
consecutive words of a benchmark item; a shorter item is one window.

1. Counts of all test terms in the training texts decide each window's rarest terms. A window with a term
   that no document has is gone at once.
2. The index holds the training postings (term, document, position) of the rarest terms, as a written table.
3. Each posting of a window's rarest term, less the term's offset, is a start; starts that both rarest terms
   give are candidates (the intersection of offset-adjusted lists), starts up to `slop` apart are proximity matches.
4. Candidates are compared word by word with the document: exact phrase matches. Their union of positions is
   what is hit.

The benchmark's tables are broadcast only where their row count is within `BROADCAST_ROWS`, else joined by
shuffle. Documents are keyed by id and text hash, so rows that repeat one id with other texts stay apart.

Defined results: a null or wordless text has no words, no hit and is clean; an item without words has no
window; a null item id counts as an empty string; repeated rows get equal results, repeated items count once;
an empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: All but ASCII that is no digit or letter. As a union of ranges: Java matches a negated class ten times as slowly.
WORD = r"[a-z0-9\x80-\x{10FFFF}]+"
WORD_ANY_CASE = r"[a-zA-Z0-9\x80-\x{10FFFF}]+"
BROADCAST_ROWS = 200_000  # rows of a few hundred bytes at most: under 100 MB
NO_ID = -(2**63)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def _sized(df: DataFrame, n: int) -> DataFrame:
    """Broadcast where n rows are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """d and h tell texts apart: a null id counts as the least one, as equal texts have equal results under any id."""
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item, window (digest), terms of every window of every item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("at"))
    return starts.select("item", F.slice("w", F.col("at"), F.lit(width)).alias("terms")).withColumn("window", F.md5(F.array_join("terms", " ").cast("binary"))).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, slop: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrase matches (d, h, start, len, window), proximity matches (d, h, window) and the items of windows (window, item)."""
    of_items = written(windows(benchmark, width), "decon_windows")
    distinct = of_items.select("window", "terms").distinct()
    places = distinct.select("window", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term"))
    test_terms = written(places.select("term").distinct(), "decon_terms")
    text = _keyed(docs).where("text is not null")
    tokens = text.select(F.explode(words(F.col("text"))).alias("term"))
    counts = written(tokens.join(_sized(test_terms, test_terms.count()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "decon_counts")

    # The two rarest places of each window; windows with a term of no document are dropped.
    counted = places.join(counts, "term", "left")
    rank = F.row_number().over(Window.partitionBy("window").orderBy("n", "offset"))
    live = F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("window"))
    rarest = counted.withColumn("rank", rank).withColumn("least", live).where("rank <= 2 and least > 0")
    anchors = written(rarest.select("term", "window", "offset", "len", F.col("rank").alias("which")), "decon_anchors")
    n_anchors = anchors.count()
    anchor_terms = anchors.select("term").distinct()

    index = text.select("d", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    index = written(index.join(_sized(anchor_terms, n_anchors), "term").select("term", "d", "h", "pos").distinct(), "decon_postings")

    starts = index.join(_sized(anchors, n_anchors), "term").select("d", "h", "window", "len", (F.col("pos") - F.col("offset")).alias("start"), "which")
    # Within a document's window, starts in order: the same start from both terms is a candidate, a near one a proximity match.
    line = Window.partitionBy("d", "h", "window").orderBy("start", "which")
    gap, other = F.col("start") - F.lag("start").over(line), F.lag("which").over(line) != F.col("which")
    seen = starts.withColumn("gap", gap).withColumn("other", other)
    met = written(seen.where("start >= 0 and (len = 1 or (other and gap <= %d))" % slop).select("d", "h", "window", "len", "start", (F.expr("len = 1 or gap = 0")).alias("same")), "decon_met")

    exact = met.where("same")
    candidates = written(exact.join(distinct, "window").groupBy("d", "h", "start").agg(F.collect_list(F.struct("window", "len", "terms")).alias("tries")), "decon_candidates")
    keys = candidates.select("d", "h").distinct()
    n_docs = keys.count()
    held = text.join(_sized(keys, n_docs), ["d", "h"], "left_semi").dropDuplicates(["d", "h"]).select("d", "h", words(F.col("text")).alias("w"))
    tried = held.join(candidates, ["d", "h"]).select("d", "h", "start", "w", F.explode("tries").alias("t"))
    phrases = tried.where(F.slice("w", F.col("start") + 1, F.col("t.len")) == F.col("t.terms")).select("d", "h", "start", F.col("t.len").alias("len"), F.col("t.window").alias("window"))
    near = met.where("not same").select("d", "h", "window").distinct()
    return written(phrases, "decon_phrases"), near, of_items.select("window", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, slop: int = 4) -> DataFrame:
    """Words, hit words, items, verdict, phrase and proximity matches of every row of docs.

    contaminated: a hit, and share * n_hit >= n_words. n_phrases: windows that occur, at each start; n_near: windows whose
    two rarest terms stand up to `slop` words from their places.
    """
    phrases, near, of_items = matches(docs, benchmark, width, slop)
    # The union of the matches' positions, by what each adds beyond those before it.
    spans = phrases.groupBy("d", "h", "start").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("phrases"))
    before = F.max(F.col("start") + F.col("len")).over(Window.partitionBy("d", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("len")
    hits = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))).groupBy("d", "h").agg(F.sum("new").cast("long").alias("n_hit"), F.sum("phrases").alias("n_phrases"))
    items = phrases.select("d", "h", "window").join(of_items, "window").groupBy("d", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    close = near.groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_near"))
    found = hits.join(items, ["d", "h"]).join(close, ["d", "h"], "full")
    counted = _keyed(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "d", "h", F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(found, ["d", "h"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_phrases", F.lit(0)).cast("long").alias("n_phrases"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("items", none).alias("items"),
        "h",
    )
