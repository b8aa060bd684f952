"""ZIP archives as a data source: one large archive is read by many tasks.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("suffix", ".pdf").load("file:///scans")

The plan reads the archives' central directories only, and parts the wanted members, in the order of their places, into ranges of about
`partition_bytes` compressed bytes. A task opens its archive at its members' places, so it reads its range and holds one member.
Folders of very many small archives are better read by `documents.archive_members`, which needs no directory beforehand.

Rows: archive (its name), name (the member's, without folders), content, error. An archive that is none, and a member that is encrypted, of
another method than storing and deflating, or damaged, give a row with an error.
"""

from __future__ import annotations

import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64_000_000
LOCAL_HEADER = struct.Struct("<4s2B4HL2L2H")


def opened(uri: str):
    """A file system and the path in it, of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Seeks:
    """A file whose impossible places are an OSError, as they are in Python's own files."""

    def __init__(self, f):
        self.f = f

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.f.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name: str):
        return getattr(self.f, name)


@dataclass
class Member:
    name: str
    at: int
    stored: int
    size: int
    crc: int
    method: int
    encrypted: bool


@dataclass
class Range(InputPartition):
    uri: str
    archive: str
    members: list[Member]
    error: str | None = None


class ZipReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, range_bytes: int):
        self.path, self.suffix, self.range_bytes = path, suffix.lower(), range_bytes

    def _archives(self) -> list[str]:
        from pyarrow import fs

        files, path = opened(self.path)
        if files.get_file_info(path).type == fs.FileType.File:
            return [self.path]
        prefix = self.path.rstrip("/")
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(prefix + f.path[len(path.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri in self._archives():
            archive = posixpath.basename(uri)
            try:
                files, path = opened(uri)
                with files.open_input_file(path) as f, zipfile.ZipFile(_Seeks(f)) as z:
                    found = [Member(posixpath.basename(i.filename), i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, bool(i.flag_bits & 1)) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(self.suffix)]
            except (zipfile.BadZipFile, OSError) as e:
                out.append(Range(uri, archive, [], str(e)))
                continue
            held, size = [], 0
            for m in sorted(found, key=lambda m: m.at):
                if held and size + m.stored > self.range_bytes:
                    out.append(Range(uri, archive, held))
                    held, size = [], 0
                held.append(m)
                size += m.stored
            if held:
                out.append(Range(uri, archive, held))
        return out or [Range(self.path, "", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Range)
        if partition.error is not None:
            yield partition.archive, None, None, partition.error
        if not partition.members:
            return
        files, path = opened(partition.uri)
        with files.open_input_file(path) as f:
            for m in partition.members:
                try:
                    yield partition.archive, m.name, content(f, m), None
                except (ValueError, zlib.error, OSError, struct.error) as e:
                    yield partition.archive, m.name, None, str(e)


def content(f, m: Member) -> bytes:
    """A member's bytes, from its place in an open archive."""
    if m.encrypted:
        raise ValueError("the member is encrypted")
    f.seek(m.at)
    head = LOCAL_HEADER.unpack(f.read(LOCAL_HEADER.size))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no member is at this place")
    f.seek(m.at + LOCAL_HEADER.size + head[-2] + head[-1])
    raw = f.read(m.stored)
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {m.method} is not supported")
    got = raw if m.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if len(got) != m.size or zlib.crc32(got) != m.crc:
        raise ValueError("the member is damaged")
    return got


class ZipMembers(DataSource):
    """Options: path, suffix (`.pdf`), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], self.options.get("suffix", ".pdf"), int(self.options.get("partition_bytes", RANGE_BYTES)))
