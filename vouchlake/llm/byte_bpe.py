"""Byte-level BPE by a rank file: encoding by ranked merges in Spark's higher-order functions, decoding by concatenation.

1. A pass over whole texts cuts them by the pattern. Texts are taken in blocks; a block numbers its distinct words, and a
   document becomes the row of its words' numbers. Words that are entries of the rank file have their id as number. Rows are
   written bucketed by block; a block's other words go out in ranges of their hash, many words a row.
2. A task of a range passes on each distinct word once, before the first row that has it. There it is encoded: a word is an array of byte
   ids; a fold over the array merges the adjacent pair of the least rank, the leftmost of equals, until no pair has a rank. Ranks are a
   literal: a sparse table in which a pair's place is known from its ids, so that a look-up costs the same for every
   size of the vocabulary. A merged pair's rank is its id. The rows of words then become rows of ids.
3. Each block gets the ids of its own words, and its documents, which stay where they were written, read their ids by number.
   Only words and their ids are shuffled, no text and no document.

The map holds, for each entry of the file, the pair that it is merged from when its own bytes are encoded; a fold that
reaches the bytes of an entry has reached this pair, as merges within the bytes do not depend on what is around them.
Entries that no merge reaches are met as whole words only, as in the library whose ids these are.

Decoding maps ids to the hexadecimal text of their bytes, joins them and reads them back.

Defined results: a null text is empty, and has no ids; rows repeat as they are; the bytes of characters that
are not Unicode text (lone surrogates) do not occur in Spark's strings. A word's fold takes the square of its
bytes: seconds for 10,000 bytes without a cut. Other columns are ignored. Letters, numbers and white space are
those of the installed `regex` module's Unicode version.
"""

from __future__ import annotations

import base64
import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, short_batches, sliced

SHIFT = 20  # ids have fewer bits
PLACE = 24  # places in a word have fewer bits
NONE = 2**31 - 1
BLOCK_BYTES = 8_000_000
BLOCK_WORDS = 500_000
RANGE_BYTES, MOST_RANGES = 32_000_000, 16_384  # of text for each range of words
KEPT, LONGEST = 200_000, 64
ROWS_OUT = 5_000
BACK_ROWS = 200
JOINED = regex.compile(r"\s \s")  # white space around a space: no cut is sure before it


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def merges(path: str) -> tuple[list[int], dict[tuple[int, int], int]]:
    """The ids of the 256 bytes; and of each entry of several bytes the pair of ids that it is merged from."""
    ranks = ranks_of(path)
    pairs = {}
    for entry, rank in ranks.items():
        parts = [entry[i : i + 1] for i in range(len(entry))]
        while len(parts) > 2:
            found = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            if (least := min(found)) >= rank:
                break
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return [ranks[bytes([b])] for b in range(256)], pairs


@functools.lru_cache(maxsize=4)
def _literals(path: str) -> tuple[str, str, str, int]:
    """JSON of the byte ids and of the rank map in two arrays, which the optimizer reads into literals; and the id of a word's ends, which no pair has.

    The map is a sparse table of which each row, the pairs of one first id, is moved by an offset so that no two entries
    meet: the entry of a pair is at offset[first] + second, and holds first and rank.
    """
    of_bytes, pairs = merges(path)
    end = 1 + max([*of_bytes, *pairs.values()])
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pairs.items():
        rows.setdefault(a, []).append((b, rank))
    wide = 2 * len(pairs) + 1
    offsets, table, taken, move = [1] * (end + 1), [end << SHIFT + 1] * (wide + end + 2), np.zeros(wide + end + 2, bool), np.random.default_rng(7)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        second = np.array([b for b, _ in row])
        while taken[second + offsets[a]].any():
            offsets[a] = int(move.integers(1, wide))
        taken[second + offsets[a]] = True
        for b, rank in row:
            table[offsets[a] + b] = a << SHIFT | rank
    return json.dumps(of_bytes), json.dumps(offsets), json.dumps(table), end


def encoded(word: Column, path: str) -> Column:
    """Ids of a word (binary, not empty), by ranked merges."""
    *tables, end = _literals(path)
    tables = F.struct(*[F.from_json(F.lit(j), "array<bigint>").alias(n) for n, j in zip(("bytes", "offsets", "entries"), tables, strict=True)])
    none = F.lit(1 << SHIFT)  # ranks are less than this
    every = F.lit(2**30)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def fold(t: Column) -> Column:
        def pair(a: Column, b: Column) -> Column:
            """An element: the rank of a and the b after it, and a. The entry of another first id leaves a value of `none` or more."""
            entry = F.get(t["entries"], (F.get(t["offsets"], a.cast("int")) + b).cast("int"))
            return F.shiftleft(F.least(entry.bitwiseXOR(F.shiftleft(a, SHIFT)), none), SHIFT).bitwiseOR(a)

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << SHIFT) - 1))

        def start(p: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: pair(F.get(p, i - 1), F.get(p, i)))

        def step(e: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                new, at = F.shiftright(least, PLACE), least.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
                after = F.coalesce(id_of(F.get(e, at + 2)), F.lit(end).cast("bigint"))
                around = F.array(pair(id_of(F.get(e, at - 1)), new), pair(new, after))
                return F.when(new < none, F.concat(F.slice(e, F.lit(1), at - 1), around, F.slice(e, at + 3, every))).otherwise(e)

            # The least rank, and of equals the leftmost, with its place.
            return let(F.array_min(F.transform(e, lambda x, i: F.shiftleft(F.shiftright(x, SHIFT), PLACE).bitwiseOR(i.cast("bigint")))), merge)

        latin = F.decode(word, "ISO-8859-1")
        own = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(t["bytes"], F.ascii(F.substring(latin, i, F.lit(1)))))
        ends = F.array(F.lit(end).cast("bigint"))
        steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
        # The first element is the word's start, which merges with nothing.
        return F.aggregate(steps, let(F.concat(ends, own, ends), start), step, lambda e: F.transform(F.slice(e, F.lit(2), every), id_of))

    return let(tables, fold).cast("array<int>")


class Numbered:
    """The words of a block by number: entries of the rank file by id, others from `base` on in their order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.base, self.find = ranks, 1 + max(ranks.values(), default=-1), regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def _number(self, word: str) -> bytes:
        b = word.encode("utf-8", "replace")
        n = self.ranks.get(b)
        return (self.words.setdefault(b, self.base + len(self.words)) if n is None else n).to_bytes(4, "little")

    def _numbers(self, text: str) -> bytes:
        return b"".join(map(self._number, self.find(text)))

    def _piece(self, piece: str) -> bytes:
        """Numbers of a space and the piece."""
        # A space and letters only are one word by the pattern that this cutting is for.
        got = self._number(" " + piece) if piece.isalpha() else self._numbers(" " + piece)
        if len(piece) <= LONGEST:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's words. The pattern always cuts before a single space that stands between other characters, of which one is not white space; such pieces are numbered once."""
        self.size += len(text)
        if "  " in text or text[:1] == " " or text[-1:] == " " or JOINED.search(text):
            return np.frombuffer(self._numbers(text), "<u4")
        first, *rest = text.split(" ")
        kept, piece = self.kept.get, self._piece
        return np.frombuffer(b"".join([self._numbers(first), *[kept(p) or piece(p) for p in rest]]), "<u4")


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by place, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("range", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])
SPREAD = pa.schema([("range", pa.int32()), ("word", pa.binary()), ("block", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("packed", pa.binary())])


def _cut(sizes: bytes, words: bytes) -> list[bytes]:
    """The words of a row."""
    raw = zstandard.decompress(words)
    ends = np.cumsum(_unpacked(sizes), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows written once, in buckets of their block: what is grouped by block later stays where it is."""
    spark, name = rows.sparkSession, f"bpe_rows_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>) and packed (the ids as unsigned 32-bit integers, least byte first) of every row. ranks: the path of a rank file, which every executor has; pattern: one that cuts before single spaces and runs of letters, as byte-level vocabularies' do."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    spark = docs.sparkSession
    short_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(least, size // RANGE_BYTES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, block = Numbered(ranks_of(path), pattern), TaskContext.get().partitionId() << 32

        def words() -> Iterator[pa.RecordBatch]:
            every = list(n.words)
            if not every:
                return n.clear()
            of = np.fromiter((zlib.crc32(w) % ranges for w in every), np.int32, len(every))
            order = np.argsort(of, kind="stable")
            cut = np.nonzero(np.append(True, of[order][1:] != of[order][:-1]))[0].tolist()
            for a, b in zip(cut, [*cut[1:], len(every)], strict=True):
                at = order[a:b]
                own = [every[i] for i in at.tolist()]
                row = (block, None, None, int(of[at[0]]), _packed(np.array([len(w) for w in own])), zstandard.compress(b"".join(own), 3), _packed(np.diff(at + n.base, prepend=0)))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ROWS, strict=True)], schema=ROWS)
            n.clear()

        for x in sliced(batches, 200):
            got = [_packed(n.of(t)) if t else None for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([block] * x.num_rows, pa.int64()), x.column("doc_id"), pa.array(got, pa.binary()), *[pa.nulls(x.num_rows, f.type) for f in list(ROWS)[3:]]], schema=ROWS)
            if n.size >= BLOCK_BYTES or len(n.words) >= BLOCK_WORDS:
                yield from words()
                block += 1
        yield from words()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _bucketed(texts.mapInArrow(number, "block long, doc_id long, numbers binary, range int, sizes binary, words binary, places binary"), max(least, -(-size // BLOCK_BYTES)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, out = None, set(), []
        for x in batches:
            for of, block, sizes, words, places in zip(*[x.column(c).to_pylist() for c in ("range", "block", "sizes", "words", "places")], strict=True):
                if of != held:
                    held, seen = of, set()
                for w in _cut(sizes, words):
                    if w not in seen:
                        seen.add(w)
                        out.append((of, w, None, None, None, None))
                out.append((of, None, block, sizes, words, places))
                while len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:ROWS_OUT], strict=True), SPREAD, strict=True)], schema=SPREAD)
                    del out[:ROWS_OUT]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPREAD, strict=True)], schema=SPREAD)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, {}
        for x in batches:
            out = []
            for of, word, ids, block, sizes, words, places in zip(*[x.column(c).to_pylist() for c in ("range", "word", "word_ids", "block", "sizes", "words", "places")], strict=True):
                if of != held:
                    held, known = of, {}
                if word is not None:
                    known[word] = np.array(ids, "<u4").tobytes()
                    continue
                own = [known[w] for w in _cut(sizes, words)]
                out.append((block, places, _packed(np.array([len(i) // 4 for i in own])), _packed(np.frombuffer(b"".join(own), "<u4"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BACK, strict=True)], schema=BACK)

    # The three steps of a range keep the order of its rows: a word comes before the rows that have it.
    dealt = rows.where("range is not null").select("range", "block", "sizes", "words", "places").repartition(ranges, "range").sortWithinPartitions("range")
    passed = dealt.mapInArrow(spread, "range int, word binary, block long, sizes binary, words binary, places binary")
    folded = passed.select("range", "word", F.when(F.col("word").isNotNull(), encoded(F.col("word"), path)).alias("word_ids"), "block", "sizes", "words", "places")
    back = folded.mapInArrow(meet, "block long, places binary, counts binary, ids binary")
    base = 1 + max(ranks_of(path).values())

    def gather(numbers: pa.Table, known: pa.Table) -> pa.Table:
        places = [np.cumsum(_unpacked(p), dtype=np.int64) for p in known.column("places").to_pylist()]
        counts = [_unpacked(c).astype(np.int64) for c in known.column("counts").to_pylist()]
        flat = np.concatenate([np.arange(base, dtype=np.uint32), *[_unpacked(i) for i in known.column("ids").to_pylist()]])
        length = np.ones(1 + max([base - 1, *[int(p[-1]) for p in places]]), np.int64)
        start = np.arange(len(length))
        at = base
        for p, c in zip(places, counts, strict=True):
            length[p], start[p] = c, at + np.cumsum(c) - c
            at += int(c.sum())
        del places, counts

        def batch(x: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw in x.column("numbers").to_pylist():
                every = np.zeros(0, np.int64) if raw is None else _unpacked(raw).astype(np.int64)
                n = length[every]
                out.append(flat[np.repeat(start[every] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            ends = np.concatenate([[0], np.cumsum([len(d) for d in out])])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)))
            return pa.RecordBatch.from_arrays([x.column("doc_id"), ids, pa.array([d.astype("<u4").tobytes() for d in out], pa.binary())], schema=OUT)

        # A block goes back in short batches, as the JVM holds a batch outside its heap.
        return pa.Table.from_batches([batch(x) for x in sliced(numbers.to_batches(), BACK_ROWS)], schema=OUT)

    read = rows.where("range is null").select("block", "doc_id", "numbers")
    return read.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(gather, "doc_id long, ids array<int>, packed binary")


def decoded(ids: Column, ranks: str | None = None) -> Column:
    """The bytes of an array of ids: the pieces of a literal table (hexadecimal, by id), joined."""
    entries = ranks_of(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    table = [""] * (1 + max(entries.values()))
    for entry, rank in entries.items():
        table[rank] = entry.hex()
    pieces = F.split(F.lit(",".join(table)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
