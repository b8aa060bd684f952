"""Document sources: files and archives as bytes, adaptive text with pluggable extractors, settings and counters.

Extractors are functions from bytes to text (or a list of page texts) that run in Arrow batches. No PDF or OCR
library is assumed: `plain_text` decodes UTF-8 and serves as the stub. An extractor's error becomes a message
in the row, never a failed job.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.text import coerce_double, json_object, strip
from .shared import short_batches

Extractor = Callable[[bytes], "str | list[str]"]

#: Bytes that a task holds as Python objects at a time, beside one row larger than that.
SLICE_BYTES = 4_000_000


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def form_feed_pages(content: bytes) -> list[str]:
    """Pages parted by form feeds, as text tools write them."""
    return content.decode("utf-8", "replace").split("\f")


def files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """path, name, modificationTime and content of every file below a folder whose name ends so, in any case."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "content")


def accepted(uploads: DataFrame, name: str = "name", suffix: str = ".pdf") -> DataFrame:
    """uploads with an error where the name does not end so."""
    ok = F.endswith(F.lower(F.col(name)), F.lit(suffix))
    return uploads.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce(F.col(name), F.lit("")))))


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most_bytes`, a row at least, so that few contents are Python objects at a time."""
    for b in batches:
        held = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in b.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type)]
        blocks = np.cumsum(np.sum(held, axis=0, dtype=np.int64)) // most_bytes if held else np.zeros(b.num_rows, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield b.slice(start, end - start)


def collected(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most_bytes: int = SLICE_BYTES, most_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most_bytes`, as many rows as that holds: a batch a row would cost more than its row."""
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        if held and (weight + size(r) > most_bytes or len(held) >= most_rows):
            yield batch()
            held, weight = [], 0
        held.append(r)
        weight += size(r)
    if held:
        yield batch()


def archive_members(archives: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """archive, name and content of every member of ZIP files that ends so; an archive's own error in a row of its own.

    Members are read one at a time; a task holds a slice of archives' bytes and a batch of members, both of a few megabytes or one row.
    """
    short_batches(archives.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in sliced(batches):
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir() and info.filename.lower().endswith(suffix):
                                yield path, posixpath.basename(info.filename), z.read(info), None
                except (zipfile.BadZipFile, OSError, RuntimeError) as e:
                    yield path, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collected(members(batches), schema, lambda r: len(r[2] or b""))

    return archives.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "archive string, name string, content binary, error string")


def bundled(files: DataFrame, by: str) -> DataFrame:
    """by and content: a ZIP archive of the files (name, content) of each batch.

    Files are sorted by batch and name within tasks and put in as they come: a task holds one archive's bytes, and many small archives share its calls.
    """
    kind = files.schema[by].dataType
    schema = to_arrow_schema(StructType([StructField(by, kind), StructField("content", BinaryType())]))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        raw, z, current = io.BytesIO(), None, None
        for b in sliced(batches):
            for k, name, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if z is None or k != current:
                    if z is not None:
                        z.close()
                        yield current, raw.getvalue()
                    raw, current = io.BytesIO(), k
                    z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close()
            yield current, raw.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collected(archives(batches), schema, lambda r: len(r[1]))

    rows = files.select(by, "name", "content").repartition(F.col(f"`{by}`")).sortWithinPartitions(F.col(f"`{by}`"), "name")
    return rows.mapInArrow(run, f"`{by}` {kind.simpleString()}, content binary")


def page_text(pages: Column) -> Column:
    """Pages joined by line ends, blank ones dropped, stripped."""
    return strip(F.array_join(F.filter(pages, lambda p: p.isNotNull() & (strip(p) != "")), "\n"))


def extracted(docs: DataFrame, extractor: Extractor, to: str, content: str = "content") -> DataFrame:
    """docs with `to`, a struct<text, error> of what the extractor gives for the bytes."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("struct<pages: array<string>, error: string>")
    def run(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])
        for whole in raw:
            parts = []
            for part in sliced([pa.RecordBatch.from_arrays([whole], ["content"])]):
                out = []
                for b in part.column(0).to_pylist():
                    try:
                        got = extractor(b) if b is not None else ""
                        out.append({"pages": [got] if isinstance(got, str) else list(got), "error": None})
                    except Exception as e:  # the document's own failure
                        out.append({"pages": None, "error": f"{type(e).__name__}: {e}"})
                parts.append(pa.array(out, kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    got = docs.withColumn("_got", run(F.col(content)))
    return got.withColumn(to, F.struct(page_text(F.col("_got.pages")).alias("text"), F.col("_got.error").alias("error"))).drop("_got")


def adaptive_text(docs: DataFrame, direct: Extractor, ocr: Extractor | None = None, least: int = 100, force_ocr: bool = False) -> DataFrame:
    """docs with text and text_error: direct text of `least` characters or more, else OCR, else what direct text there is.

    The costly extractor stands behind a filter, so only the rows that need it reach it.
    """
    first = extracted(docs, direct, "_direct") if not force_ocr else docs.withColumn("_direct", F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("error")))
    enough = F.coalesce(F.length("_direct.text") >= least, F.lit(False))
    done = first.where(enough).withColumns({"text": F.col("_direct.text"), "text_error": F.lit(None).cast("string")})
    rest = first.where(~enough)
    rest = extracted(rest, ocr, "_ocr") if ocr else rest.withColumn("_ocr", F.struct(F.lit(None).cast("string").alias("text"), F.lit("no OCR extractor").alias("error")))
    text = F.coalesce(F.when(F.col("_ocr.text") != "", F.col("_ocr.text")), F.when(F.col("_direct.text") != "", F.col("_direct.text")))
    error = F.when(text.isNull(), F.coalesce("_ocr.error", "_direct.error", F.lit("no text found")))
    return done.drop("_direct").unionByName(rest.withColumns({"text": text, "text_error": error}).drop("_direct", "_ocr"))


def enough_text(text: Column, least: int = 50) -> Column:
    """The error of a text that is too short, else null."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) < least, "OCR failed or insufficient text extracted")


def key_values(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with key and value of the lines with an equals sign, cut at the first."""
    parts = F.split(F.col(value), "=", 2)
    kept = rows.where(F.contains(value, F.lit("=")))
    return kept.select(*[c for c in rows.columns if c != value], strip(parts[0]).alias("key"), strip(parts[1]).alias("value"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a settings file's lines; the last of a repeated key is for the reader to choose."""
    return key_values(spark.read.text(path))


def counter_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw with email, n of each counter of a JSON object; what does not parse has none."""
    counts = F.coalesce(F.from_json(F.col(value), "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    return raw.select(*[c for c in raw.columns if c != value], F.explode(counts).alias("email", "n"))


def counters(spark: SparkSession, path: str) -> DataFrame:
    """email, n of a JSON file of counters."""
    return counter_rows(spark.read.text(path, wholetext=True))


def write_counters(counts: DataFrame, path: str) -> None:
    """A JSON object a line, for any number of users."""
    counts.select("email", "n").write.mode("overwrite").json(path)


def copied(spark: SparkSession, source: DataFrame, folder: str) -> DataFrame:
    """Store path, name and content of files as a table, and read it back: the object store's put and get."""
    source.select("path", "name", "content").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


MODEL_FIELDS = ["Invoice Number", "Invoice Date", "GST Number", "Taxable Amount", "CGST Amount", "SGST Amount", "IGST Amount", "Final Amount"]


def model_records(docs: DataFrame, provider: Callable[[str], str] | None, text: str = "text") -> DataFrame:
    """docs with `model`, the coerced record of a text model's reply, null without provider or usable JSON.

    provider: text to reply, called in Arrow batches; its errors count as no reply.
    """
    if provider is None:
        reply = docs.withColumn("_reply", F.lit(None).cast("string"))
    else:

        @F.pandas_udf("string")
        def ask(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                try:
                    out.append(provider(t))
                except Exception:  # any failure is an empty reply
                    out.append(None)
            return pd.Series(out, dtype="object")

        reply = docs.withColumn("_reply", ask(F.col(text)))
    got = F.from_json(json_object(F.col("_reply")), "map<string,string>")
    value = lambda k: F.try_element_at(got, F.lit(k))
    amount = lambda k: coerce_double(value(k)).cast("decimal(18,2)")
    zero = lambda k: F.coalesce(amount(k), F.lit(0).cast("decimal(18,2)"))
    text_there = lambda k, c: F.when(F.coalesce(value(k), F.lit("")) != "", c).otherwise(0.4)
    number_there = lambda k: F.when(amount(k).isNotNull(), 0.85).otherwise(0.4)
    conf = [("Invoice Number", text_there("Invoice Number", 0.85)), ("Invoice Date", text_there("Invoice Date", 0.85)), ("GST Number", text_there("GST Number", 0.9)), *[(k, number_there(k)) for k in MODEL_FIELDS[3:]]]
    record = F.struct(
        value("Invoice Number").alias("invoice_number"), value("Invoice Date").alias("invoice_date"), value("GST Number").alias("gst_number"),
        amount("Taxable Amount").alias("taxable_amount"), amount("Taxable Amount").alias("sub_total"), zero("CGST Amount").alias("cgst_amount"),
        zero("SGST Amount").alias("sgst_amount"), zero("IGST Amount").alias("igst_amount"), amount("Final Amount").alias("final_amount"),
        (F.coalesce(value("GST Number"), F.lit("")) != "").alias("is_gst_invoice"),
        F.create_map(*[x for k, v in conf for x in (F.lit(k.lower().replace(" ", "_")), v)]).alias("confidence"),
        F.array(F.lit("AI_MODEL_EXTRACTION")).alias("rules_applied"),
    )
    return reply.withColumn("model", F.when(got.isNotNull() & (F.size(got) > 0), record)).drop("_reply")
