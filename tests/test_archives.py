"""ZIP archives as a data source, read in ranges by several tasks."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vouchlake.sources.archives import RANGE_BYTES, Range, ZipMembers, ZipReader


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)


@pytest.fixture
def folder(tmp_path):
    r = random.Random(1)
    big = [(f"d{i % 7}/f{i:03d}.{'PDF' if i % 2 else 'pdf'}", r.randbytes(r.randrange(0, 9000))) for i in range(200)] + [("notes.txt", b"no document"), ("empty.pdf", b"")]
    archive(tmp_path / "big.zip", big)
    archive(tmp_path / "plain.ZIP", [("a.pdf", b"a" * 5000), ("a.pdf", b"twice")], zipfile.ZIP_STORED)
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "none.zip", [])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "other.dat").write_bytes(b"x")
    return tmp_path, big


def test_ranges_hold_every_member_once(spark, folder):
    path, big = folder
    spark.dataSource.register(ZipMembers)
    df = spark.read.format("zip_members").option("partition_bytes", 50_000).load(str(path))
    rows = df.collect()
    want = sorted((n.rsplit("/", 1)[-1], c) for n, c in big if n.lower().endswith(".pdf"))
    assert sorted((x["name"], bytes(x["content"])) for x in rows if x["archive"] == "big.zip") == want
    assert sorted(bytes(x["content"]) for x in rows if x["archive"] == "plain.ZIP") == [b"a" * 5000, b"twice"]
    assert [(x["archive"], x["name"], x["content"]) for x in rows if x["error"]] == [("broken.zip", None, None)]
    assert df.rdd.getNumPartitions() > 10 and df.where("archive = 'big.zip'").select(F.spark_partition_id()).distinct().count() > 10
    one = spark.read.format("zip_members").option("suffix", ".txt").load(f"file://{path}/big.zip").collect()
    assert [(x["name"], bytes(x["content"]), x["error"]) for x in one] == [("notes.txt", b"no document", None)]


def test_a_range_reads_only_its_bytes(folder, monkeypatch):
    path, _ = folder
    reader = ZipReader(str(path / "big.zip"), ".pdf", 50_000)
    parts = reader.partitions()
    assert len(parts) > 10 and all(isinstance(p, Range) and sum(m.stored for m in p.members) <= 60_000 for p in parts)
    assert len(ZipReader(str(path / "big.zip"), ".pdf", RANGE_BYTES).partitions()) == 1
    raw = bytearray((path / "big.zip").read_bytes())
    keep = parts[3]
    low, high = keep.members[0].at, keep.members[-1].at + keep.members[-1].stored + 200
    (path / "big.zip").write_bytes(b"\0" * low + bytes(raw[low:high]) + b"\0" * (len(raw) - high))
    assert all(e is None for *_, e in reader.read(keep)) and len(list(reader.read(keep))) == len(keep.members)


def test_damaged_encrypted_and_unknown_members_are_errors(tmp_path):
    archive(tmp_path / "a.zip", [("a.pdf", b"hello " * 100), ("b.pdf", b"fine")])
    reader = ZipReader(str(tmp_path / "a.zip"), ".pdf", RANGE_BYTES)
    (part,) = reader.partitions()
    part.members[0].crc ^= 1
    rows = list(reader.read(part))
    assert rows[0][3] == "the member is damaged" and rows[1][2:] == (b"fine", None)
    part.members[0].crc ^= 1
    part.members[0].encrypted = True
    part.members[1].method = 99
    assert [x[3] for x in reader.read(part)] == ["the member is encrypted", "compression method 99 is not supported"]
    assert zipfile.is_zipfile(io.BytesIO((tmp_path / "a.zip").read_bytes()))


def test_no_archives(spark, tmp_path):
    spark.dataSource.register(ZipMembers)
    assert spark.read.format("zip_members").load(str(tmp_path)).collect() == []
