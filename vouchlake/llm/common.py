"""What the training-data operators share: shared storage, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows where the session has Spark's default of 10,000, which long texts make large in the JVM and in Python."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of our own in local mode; an error on a cluster."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("vouchlake.checkpoint.dir", "")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vouchlake-")
        spark.conf.set("vouchlake.checkpoint.dir", at)
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    short_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def over_texts(docs: DataFrame, make: Callable[[], Callable[[str | None], tuple]], fields: str) -> DataFrame:
    """doc_id and the fields that a function gives of each text, for every row. make() builds the function once a task."""
    schema = T.StructType.fromDDL(f"doc_id long, {fields}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in sliced(batches):
            rows = [of(t) for t in b.column("text").to_pylist()]
            made = zip(*rows, strict=True) if rows else [[]] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def hash_sample(rows: DataFrame, total: int, n: int, *keys: str) -> DataFrame:
    """n of about `total` rows, the first by hash of the keys. A filter on the hash leaves about 2n before the sort."""
    h = F.xxhash64(*keys)
    near = F.pmod(F.xxhash64(h), F.lit(2**30)) < min(2**30, -(-(2**31) * n // max(total, 1)))
    return rows.where(near).orderBy(h, *keys).limit(n)


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse; emptied when it holds `most` words or `most_bytes` of them, so memory stays bounded."""

    def __init__(self, most: int = 500_000, most_bytes: int = 20_000_000):
        super().__init__()
        self.most, self.most_bytes, self.held = most, most_bytes, 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most or self.held + len(word) > self.most_bytes:
            self.clear()
            self.held = 0
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 1000:  # a huge word is not held
            self[word] = h
            self.held += len(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
