"""Alignment of two tokenizers over a corpus: byte groups, links and how often each pair of ids is linked.

Side A is a byte-level BPE of a space and the text, side B a piece BPE of the text, which adds the space itself. Both
give the same bytes; where a token of each ends at one byte, the two are linked, and the text is cut into groups.

1. A pass over whole texts encodes both sides. Texts are taken in blocks; a block sums its linked pairs. A document
   becomes a row of its figures and of its links, 4 bytes each before compression; a block's pairs go out by stripe,
   a stripe being `STRIPE` neighbouring ids of side B.
2. A task of a stripe adds its blocks' pairs with np.add.at into a dense matrix of STRIPE rows and one column for each
   id of side A, whatever the number of blocks; row maxima are the highest counts of the B ids. So memory does not
   grow with the corpus, and a frequent id costs a stripe no more than one pair a block.
3. Counts go to the blocks by the same stripes: a block's pairs meet the matrix of their stripe (copied to as many
   salted tasks as the number of blocks asks for) and return with counts and with whether they are their B id's best.
4. Links are scored beside their block's counts.

Only ids, counts and figures are shuffled, no text.

Defined results: a null or empty text, and one whose joined bytes on a side differ from the space and the text (a text
with U+2581, for example), has no tokens: its figures are 0 and its groups ''. Texts that spell special tokens are plain
text. Repeated rows count as often as they occur; null ids are kept; other columns are ignored. No token has no
bytes, so a group has one link.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, sliced, written
from .tokens import Encoder

STRIPE = 128
BLOCK_BYTES = 32_000_000
SALT_BLOCKS = 2_000
KEPT, LONGEST = 300_000, 64
MARK = "▁"


class Pieces:
    """Ids of a sentencepiece model with byte fallback. Where no piece goes on after another character with a space, texts are cut before each single space and a piece of text is encoded once."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.length = np.array([len(b) for b in self.bytes])
        self.cuts = not any(MARK in n.lstrip(MARK) for n in names)
        self.kept: dict[str, bytes] = {}

    def _same(self, text: str) -> np.ndarray | None:
        ids = np.array(self.model.encode(text, num_threads=1), "<u4")
        return ids if b"".join([self.bytes[i] for i in ids]) == b" " + text.encode("utf-8", "replace") else None

    def _piece(self, piece: str) -> bytes:
        ids = self._same(piece)
        if ids is None:
            return b""
        got = ids.tobytes()
        if len(piece) <= LONGEST:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = got
        return got

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of the text, or None where their bytes are not those of a space and the text."""
        if not self.cuts or "  " in text or text[:1] == " " or text[-1:] == " ":
            return self._same(text)
        kept, piece = self.kept.get, self._piece
        got = [kept(p) or piece(p) for p in text.split(" ")]
        return np.frombuffer(b"".join(got), "<u4") if all(got) else None


class Aligner:
    """Groups and links of a text."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, model: str | None = None):
        self.a = Encoder(vocabulary, ranks, plain=True)
        self.b = Pieces(model or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes = self.a.bytes_of()
        self.length = np.array([len(x) for x in self.bytes])
        self.texts = [[np.array([f"{i}{end}".encode() for i in range(n)], object) for end in (",", end, "")] for n, end in ((len(self.bytes), "|"), (len(self.b.bytes), ";"))]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B, and the places of the linked tokens among them; None without tokens."""
        if not text or (b := self.b.ids(text)) is None:
            return None
        a = self.a.ids(" " + text)
        ends_a, ends_b = np.cumsum(self.length[a]), np.cumsum(self.b.length[b])
        if ends_a[-1] != ends_b[-1] or b"".join([self.bytes[i] for i in a]) != b" " + text.encode("utf-8", "replace"):
            return None
        at = np.searchsorted(ends_a, ends_b)
        linked = np.nonzero(ends_a[at] == ends_b)[0]
        return a, b, at[linked], linked

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
        """The groups as text: a1,a2|b1;a3|b2,b3"""
        out = np.empty(len(a) + len(b), object)
        of_a, of_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))  # each token's group
        before_b, before_a = np.concatenate([[0], at_b + 1])[of_a], (at_a + 1)[of_b]
        for ids, place, last, tables in ((a, np.arange(len(a)) + before_b, at_a, self.texts[0]), (b, np.arange(len(b)) + before_a, at_b, self.texts[1])):
            texts = tables[0][ids]
            texts[last] = tables[1][ids[last]]
            out[place] = texts
        out[-1] = self.texts[1][2][b[-1]]
        return b"".join(out.tolist())


def _packed(codes: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view("<u2").reshape(-1, 2).T).tobytes(), 3)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), "<u2").reshape(2, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _numbers(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<i8").tobytes(), 1)


def _of_numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<i8")


ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("stripe", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])
ROWS_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, stripe int, pairs binary, counts binary"
TOTALS = pa.schema([("stripe", pa.int32()), ("b", pa.int32()), ("ids", pa.binary()), ("totals", pa.binary()), ("best", pa.int64())])
BACK = pa.schema([("block", pa.int64()), ("pairs", pa.binary()), ("totals", pa.binary()), ("best", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if not len(keys):
        return []
    cut = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0].tolist()
    return list(zip(cut, [*cut[1:], len(keys)], strict=True))


def _rows(docs: DataFrame, make) -> DataFrame:
    """Rows of documents (stripe is null) and of the pairs of blocks, written. A linked pair's code is the B id above 16 bits and the A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, size, held = make(), 0, []
        block = int.from_bytes(os.urandom(7), "little")

        def summed() -> None:
            codes, counts = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            keys, of = np.unique(codes, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, of, counts)
            held[:] = [(keys, sums)]

        def sent() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            summed()
            codes, sums = held[0]
            stripes = (codes >> np.uint32(16)) // STRIPE
            runs = _runs(stripes)
            n = len(runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), *[pa.nulls(n, f.type) for f in list(ROWS)[1:7]], pa.array([int(stripes[a]) for a, _ in runs], pa.int32())]
                + [pa.array([_packed(codes[a:b]) for a, b in runs], pa.binary()), pa.array([_numbers(sums[a:b]) for a, b in runs], pa.binary())], schema=ROWS)
            held.clear()

        for x in sliced(batches, 100):
            found = []
            for t in x.column("text").to_pylist():
                got = align(t)
                if got is None:
                    found.append((0, 0, 0, "", None))
                    continue
                a, b, at_a, at_b = got
                codes = (b[at_b] << np.uint32(16)) | a[at_a]
                held.append((codes, np.ones(len(codes), np.int64)))
                size += len(t)
                found.append((len(a), len(b), len(codes), hashlib.sha256(align.groups(*got)).hexdigest(), _packed(codes)))
            n = x.num_rows
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(ROWS)[2:7], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), x.column("doc_id"), *columns, *[pa.nulls(n, f.type) for f in list(ROWS)[7:]]], schema=ROWS)
            if held:
                summed()
            if size >= BLOCK_BYTES:
                yield from sent()
                block, size = int.from_bytes(os.urandom(7), "little"), 0
        yield from sent()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(run, ROWS_DDL), "align_rows")  # written once, so a block's name holds


def _totals(pairs: DataFrame, width: int, stripes: int) -> DataFrame:
    """For each B id: the A ids it is linked with, their counts, and the highest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, dense = None, np.zeros((STRIPE, width), np.int64)

        def maxima() -> Iterator[pa.RecordBatch]:
            best = dense.max(1)
            for row in np.nonzero(best)[0].tolist():
                ids = np.nonzero(dense[row])[0]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((stripe, stripe * STRIPE + row, ids.astype("<u2").tobytes(), _numbers(dense[row, ids]), int(best[row])), TOTALS, strict=True)], schema=TOTALS)
            dense.fill(0)

        for x in batches:
            for s, codes, counts in zip(x.column("stripe").to_pylist(), x.column("pairs").to_pylist(), x.column("counts").to_pylist(), strict=True):
                if s != stripe:
                    if stripe is not None:
                        yield from maxima()
                    stripe = s
                codes = _unpacked(codes)
                np.add.at(dense, ((codes >> np.uint32(16)).astype(np.int64) - s * STRIPE, (codes & np.uint32(0xFFFF)).astype(np.int64)), _of_numbers(counts))
        if stripe is not None:
            yield from maxima()

    dealt = pairs.select("stripe", "pairs", "counts").repartition(stripes, "stripe").sortWithinPartitions("stripe")
    return written(dealt.mapInArrow(run, "stripe int, b int, ids binary, totals binary, best long"), "align_totals")


def _returned(pairs: DataFrame, totals: DataFrame, width: int, stripes: int, salts: int) -> DataFrame:
    """To each block the counts of its pairs, and whether they are their B id's best: pairs meet the totals of their stripe."""
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    asked = pairs.select("stripe", salt.alias("salt"), "block", "pairs", *none("int", "b"), *none("binary", "ids", "totals"), *none("long", "best"))
    known = totals.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *none("long", "block"), *none("binary", "pairs"), "b", "ids", "totals", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, dense, best = None, np.zeros((STRIPE, width), np.int64), np.zeros(STRIPE, np.int64)
        for x in batches:
            out = []
            c = {n: x.column(n).to_pylist() for n in ("stripe", "block", "pairs", "b", "ids", "totals", "best")}
            for i, s in enumerate(c["stripe"]):
                if s != stripe:
                    dense.fill(0)
                    best.fill(0)
                    stripe = s
                if c["b"][i] is not None:
                    row = c["b"][i] - s * STRIPE
                    dense[row, np.frombuffer(c["ids"][i], "<u2")] = _of_numbers(c["totals"][i])
                    best[row] = c["best"][i]
                    continue
                codes = _unpacked(c["pairs"][i])
                row = (codes >> np.uint32(16)).astype(np.int64) - s * STRIPE
                count = dense[row, (codes & np.uint32(0xFFFF)).astype(np.int64)]
                out.append((c["block"][i], c["pairs"][i], _numbers(count), (count == best[row]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), BACK, strict=True)], schema=BACK)

    both = known.unionByName(asked).repartition(stripes * salts, "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("b").asc_nulls_last())
    return both.select("stripe", "block", "pairs", "b", "ids", "totals", "best").mapInArrow(run, "block long, pairs binary, totals binary, best binary")


def align(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """A row for each of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The paths are those of the tokenizers' files, which every executor has."""
    spark = docs.sparkSession
    short_batches(spark)
    one = Aligner(vocabulary, ranks, model)
    width, stripes = len(one.bytes), -(-len(one.b.bytes) // STRIPE)
    rows = _rows(docs, lambda: Aligner(vocabulary, ranks, model))
    pairs = rows.where("stripe is not null").select("stripe", "block", "pairs", "counts")
    totals = _totals(pairs, width, stripes)
    n = rows.agg(F.approx_count_distinct("block")).first()[0] or 1
    back = _returned(pairs, totals, width, stripes, -(-n // SALT_BLOCKS))
    none = lambda t, *names: [F.lit(None).cast(t).alias(x) for x in names]
    figures = ["doc_id", "n_a", "n_b", "n_groups"]
    first = back.select("block", F.lit(0).alias("kind"), "pairs", "totals", "best", *none("long", *figures), *none("string", "groups_sha256"), *none("binary", "links"))
    read = rows.where("stripe is null").select("block", F.lit(1).alias("kind"), *none("binary", "pairs", "totals", "best"), *figures, "groups_sha256", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, table = None, [], None
        for x in batches:
            out = []
            c = {n: x.column(n).to_pylist() for n in x.schema.names}
            for i, of in enumerate(c["block"]):
                if of != block:
                    block, held, table = of, [], None
                if not c["kind"][i]:
                    held.append((_unpacked(c["pairs"][i]), _of_numbers(c["totals"][i]), np.frombuffer(c["best"][i], bool)))
                    continue
                if table is None and held:
                    codes, count, best = (np.concatenate(v) for v in zip(*held, strict=True))
                    order = np.argsort(codes, kind="stable")
                    table, held = (codes[order], count[order], best[order]), []
                links = c["links"][i]
                n, best_links, total = 0, 0, 0
                if links is not None:
                    codes = _unpacked(links)
                    at = np.searchsorted(table[0], codes)
                    n, best_links, total = len(codes), int(table[2][at].sum()), int(table[1][at].sum())
                out.append((*[c[f][i] for f in figures], n, best_links, total, c["groups_sha256"][i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    dealt = first.unionByName(read).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
