"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame
that is written as Parquet and read again for the next one. All but the last return the columns of documents.
Rows with null ids pass the filtering stages; a null text is neither toxic nor contaminated nor a duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm import decontamination, near_duplicates, packing, secrets, toxicity
from vouchlake.llm.common import fold, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3
BROADCAST_ROWS = 200_000


def _few(df: DataFrame) -> DataFrame:
    """Ids, broadcast where there are few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.keep_below(docs.select(COLUMNS), model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one whose id and text name it. Rows are told apart by id and digest; of equal rows of it, one is kept. Null texts are all kept."""
    docs = docs.select(COLUMNS)
    classes = written(near_duplicates.near_duplicates(docs).where("key is not null").select("doc_id", "key", "class_id"), "pipeline_classes")
    first = F.col("class_id") == F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key")
    dropped = written(classes.where(~first).select("doc_id", "key").distinct(), "pipeline_dropped")
    again = written(classes.where(first).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "pipeline_repeated")

    def joined(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.md5(F.col("text").cast("binary")) == F.col("of_key"))
        return rows.join(_few(ids.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"))), same, how)

    kept = joined(docs, dropped, "left_anti")
    if again.isEmpty():
        return kept
    once = joined(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return joined(kept, again, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears. Rows are told apart by id and text hash."""
    docs = docs.select(COLUMNS)
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dropped = written(found.where("contaminated").select("doc_id", "h").distinct(), "pipeline_contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_h"))
    return docs.join(_few(dropped.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))), same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, digests and token ids are not SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
