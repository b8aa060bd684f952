"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat_format, decontamination, filter_audit, language_id, lm_scoring, near_duplicates, packing, quality_rules, secrets, sharding, toxicity
from .common import fold, table

#: Window by window, by equality of joined words; the rows of documents are told apart by their number.
OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
doc_wins AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lens WHERE len(w) >= n)),
found AS (SELECT d.r, d.n, d.k, d.win, i.item FROM doc_wins d JOIN wins i ON d.n = i.n AND d.win = i.win),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM found) GROUP BY r),
phrases AS (SELECT r, count(DISTINCT (k, win)) AS n_phrases FROM found GROUP BY r),
-- Proximity: the two rarest terms of a window, up to four words from their places.
tokens AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM docs),
places AS (SELECT n, win, unnest(string_split(win, ' ')) AS term, generate_subscripts(string_split(win, ' '), 1) - 1 AS off FROM (SELECT DISTINCT n, win FROM wins)),
counts AS (SELECT term, count(*) AS c FROM tokens WHERE term IN (SELECT term FROM places) GROUP BY term),
ranked AS (
  SELECT n, win, term, off, row_number() OVER (PARTITION BY win ORDER BY c, off) AS which, min(coalesce(c, 0)) OVER (PARTITION BY win) AS least
  FROM places LEFT JOIN counts USING (term)),
starts AS (SELECT r, n, win, pos - off AS s, which FROM tokens JOIN (SELECT * FROM ranked WHERE which <= 2 AND least > 0) USING (term)),
lagged AS (SELECT *, s - lag(s) OVER v AS gap, lag(which) OVER v AS other FROM starts WINDOW v AS (PARTITION BY r, win ORDER BY s, which)),
near AS (SELECT r, count(DISTINCT win) AS n_near FROM lagged WHERE s >= 0 AND n > 1 AND other <> which AND gap BETWEEN 1 AND 4 GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_phrases, 0) AS n_phrases, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN phrases USING (r) LEFT JOIN near USING (r)
"""

#: Every set of failed filters goes through every order and step.
OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS f FROM docs GROUP BY t),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 50 AS int) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS int)
    + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) AS int)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS int) + 16 * CAST(coalesce(doc_id > f, false) AS int) AS failed
  FROM docs LEFT JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(list_slice(bits, 1, s - 1)), 0) AS int) AS before FROM orders, range(1, 6) AS v(s)),
grouped AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM flags GROUP BY part, failed),
each AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (failed & (before | bit) = 0) AS kept, sum(n) FILTER (failed & bit <> 0 AND failed & before = 0) AS removed,
    sum(n) FILTER (failed & bit <> 0 AND failed & before <> 0) AS redundant, sum(n) FILTER (failed = bit) AS unique_fails,
    sum(g) FILTER (failed & bit <> 0 AND failed & before = 0) AS good_lost, sum(t) FILTER (failed & bit <> 0 AND failed & before = 0) AS toxic_lost
  FROM grouped, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS int) AS step, CAST(coalesce(kept, 0) AS bigint) AS kept, CAST(coalesce(removed, 0) AS bigint) AS removed,
  CAST(coalesce(redundant, 0) AS bigint) AS redundant, CAST(coalesce(unique_fails, 0) AS bigint) AS unique_fails, CAST(coalesce(good_lost, 0) AS bigint) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS bigint) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS bigint) AS shapley
FROM each
"""

ORACLES: dict[str, str] = {"op10_decontamination": OP10_SQL, "op12_filter_audit": OP12_SQL}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end", "toxic_sentences")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2, by_file=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "family")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"  # control strings inside texts must come back as they were
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.windows(turns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.references(docs))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.stratified_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_phrases", "n_near")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(byte_bpe.decoded(ids), 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_packing, op4_lm_scoring, op5_language_id, op6_chat_format, op7_quality_rules, op8_sharding, op9_near_duplicates, op10_decontamination, op11_byte_bpe, op12_filter_audit, op13_alignment)
}
