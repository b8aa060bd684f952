"""Language-model scoring by a weighted backoff automaton of smoothed bigrams.

States are the root and one for each context word (or the text's start). An arc of a context state for a word that
was seen after it carries log10((c(a,b) + K * P(b)) / (c(a) + K)); its failure arc to the root carries
log10(K / (c(a) + K)); the root's arcs carry log10 P(b) with P(b) = (c(b) + 1) / (N + V + 1). Where a state has no
arc for a word, the failure arc and then the root's arc are taken, which gives the formula of an arc with c(a,b) = 0:
the probabilities of a state sum to one. Each arc leads to its word's state. A text is read once from left to right
from the start's state, and the weights met add up to its score. As an arc's end is its word's state whatever state
it leaves, the states along a text are its words, so a block's texts are walked all at once, as arrays.

The order is two: triples would take the data that is exchanged over the disk that the job may use (README).

The model grows with the corpus, so it is never gathered in one place. Documents lie in blocks of a few MB:

1. Each task counts its documents' words, then their pairs, as 64-bit hashes and sends sorted arrays of
   hashes and counts, cut by hash range: (range, block, hashes, counts). Arrays travel as compressed differences.
2. Each range adds its counts up over all blocks, and returns to a block only the totals that differ from
   the block's own counts. The words' totals also give N and V.
3. Each block meets its documents again, recounts, overrides its counts by the totals returned, and so
   builds exactly the states and arcs that its texts need. All counts are those of the whole corpus.

A word that every block has costs a row of a few bytes for each block, however frequent it is. Blocks are dealt to as
many tasks as there are blocks, so a task's data does not grow with the corpus.

Defined results: a null text is an empty one, whose only token is the end; words of no learning document have
c = 0; with no learning documents N = V = 0 and P = 1; rows that repeat are counted and scored as often as
they occur; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mixed, written

END, START = np.uint64(0xE7D1), np.uint64(0x57A7)
PRIME = np.uint64(0x100000001B3)
PRIOR = 300.0
BLOCK_BYTES = 8_000_000
ROW_BYTES = 16  # of a row beside its text
BROADCAST_FILES = 50_000
FLUSH_TOKENS = 3_000_000


def tokens(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by END, and the number of tokens of each."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(int(sizes.sum()), END, np.uint64)
    ends = np.cumsum(sizes)
    for w, e in zip(words, ends.tolist(), strict=True):
        if w:
            out[e - 1 - len(w) : e - 1] = hashes.of(w)
    return out, sizes


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; START before a text's first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, their summed weights, and the order and places that lead back to each token."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    starts = np.nonzero(first)[0]
    sums = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)
    return ranked[starts], sums.astype(np.int64), order, np.cumsum(first) - 1


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, byte plane by byte plane: the upper planes of small ones are all zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint64)


def _pairs(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(before * PRIME + words)


def _with_blocks(docs: DataFrame, may_learn: Column, by_file: bool) -> tuple[DataFrame, int]:
    """block, doc_id, text, learn; and the number of blocks. by_file: docs is a plain scan; other rows are written first, so that each has a place in a file."""
    rows = docs.select("doc_id", "text", may_learn.alias("learn"))
    if by_file:
        rows = docs.select("doc_id", "text", may_learn.alias("learn"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    else:
        rows = written(rows, "lm_rows").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    # A file's rows go to slices by their place in it, as many as its own bytes of text ask for.
    sizes = rows.groupBy("file").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("size"))
    files = written(sizes.select("file", F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_BYTES)).alias("slices")), "lm_files")
    n = files.agg(F.count(F.lit(1)).alias("files"), F.sum("slices").alias("n")).first()
    slices = F.broadcast(files) if n["files"] <= BROADCAST_FILES else files
    block = F.xxhash64("file", F.pmod(F.xxhash64("at"), F.col("slices")))
    return rows.join(slices, "file").select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", "learn"), max(1, int(n["n"] or 0))


SENT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("keys", pa.binary()), ("totals", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])


def _totals(rows: DataFrame, order: int, n_blocks: int) -> DataFrame:
    """For words (order 1) or pairs (2): to each block the totals that it cannot know; in rows without block, N and V of a range."""
    shift = np.uint64(64 - max(1, math.ceil(math.log2(2 * n_blocks + 1))))  # ranges of hashes: twice the blocks or more

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                keys, sums, _, _ = counted(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                ranges = (keys >> shift).astype(np.int64)
                cut = np.nonzero(np.append(True, ranges[1:] != ranges[:-1]))[0]
                parts = list(zip(cut, [*cut[1:], len(keys)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ranges[cut]), pa.array([block] * len(cut), pa.int64()), pa.array([_packed_keys(keys[a:b]) for a, b in parts], pa.binary()), pa.array([_packed(sums[a:b]) for a, b in parts], pa.binary())], schema=SENT)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                blocks, learn = part.column("block").to_numpy(), part.column("learn").to_numpy().astype(np.int64)
                words, sizes = tokens(part.column("text").to_pylist(), hashes)
                keys = mixed(words) if order == 1 else _pairs(words, contexts(words, sizes))
                of, learn = np.repeat(blocks, sizes), np.repeat(learn, sizes)
                for block in np.unique(blocks).tolist():
                    own = of == block
                    held.setdefault(block, []).append((keys[own], learn[own]))
                waiting += len(words)
                if waiting >= FLUSH_TOKENS:
                    yield from sent()
                    waiting = 0
        yield from sent()

    def add_up(x: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for block, k, c in zip(x.column("block").to_pylist(), x.column("keys").to_pylist(), x.column("counts").to_pylist(), strict=True):
            parts.setdefault(block, []).append((_unpacked_keys(k), _unpacked(c).astype(np.int64)))
        own = {b: p[0] if len(p) == 1 else counted(*(np.concatenate(y) for y in zip(*p, strict=True)))[:2] for b, p in parts.items()}
        keys, totals, _, _ = counted(np.concatenate([k for k, _ in own.values()]), np.concatenate([c for _, c in own.values()]))
        out = [(None, order, None, None, int(totals.sum()), int((totals > 0).sum()))]
        for block, (k, c) in own.items():
            total = totals[np.searchsorted(keys, k)]
            other = total != c
            if other.any():
                out.append((block, order, _packed_keys(k[other]), _packed(total[other]), 0, 0))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BACK, strict=True)], schema=BACK)

    counts = rows.select("block", "text", F.col("learn").cast("int").alias("learn")).mapInArrow(count, "range long, block long, keys binary, counts binary")
    return counts.groupBy("range").applyInArrow(add_up, "block long, ord int, keys binary, totals binary, n long, v long")


@dataclass
class Automaton:
    """States by context word with their failure arcs, arcs by (state, word), and the root's arcs."""

    root: np.ndarray  # of each word: the weight of the root's arc
    failure: np.ndarray  # of each state: the weight of the arc to the root
    arcs: np.ndarray  # of each (state, word) of the texts: the arc's weight, or nothing (NaN) where it was never seen

    @classmethod
    def of(cls, c_word: np.ndarray, c_state: np.ndarray, c_arc: np.ndarray, state: np.ndarray, word: np.ndarray, total: int, distinct: int, prior: float) -> Automaton:
        """From the counts of words, states and arcs, and each arc's state and word."""
        p = (c_word + 1.0) / (total + distinct + 1.0)
        arcs = np.full(len(c_arc), np.nan)
        seen = np.nonzero(c_arc)[0]
        arcs[seen] = np.log10((c_arc[seen] + prior * p[word[seen]]) / (c_state[state[seen]] + prior))
        return cls(np.log10(p), np.log10(prior / (c_state + prior)), arcs)

    def walk(self, states: np.ndarray, words: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """The weight of each step from a state by a word: its arc's, or where there is none the failure arc's and the root's."""
        out = self.arcs[arcs]
        back = np.nonzero(np.isnan(out))[0]
        out[back] = self.failure[states[back]] + self.root[words[back]]
        return out


def score(docs: DataFrame, may_learn: Column, prior: float = PRIOR, by_file: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    rows, n_blocks = _with_blocks(docs, may_learn, by_file)
    of_words = written(_totals(rows, 1, n_blocks), "lm_words")
    whole = of_words.where("block is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(whole["n"] or 0), int(whole["v"] or 0)

    def traverse(x: pa.Table, back: pa.Table) -> pa.Table:
        words, sizes = tokens(x.column("text").to_pylist(), WordHashes())
        if not len(words):
            return OUT.empty_table()
        learn = np.repeat(x.column("learn").to_numpy().astype(np.int64), sizes)
        firsts = np.cumsum(sizes) - sizes

        def totalled(order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Distinct keys of the block, their corpus counts, the place of each token's key, and a token of each key."""
            keys, own, order_of, place = counted(keys, learn)
            for o, k, t in zip(back.column("ord").to_pylist(), back.column("keys"), back.column("totals"), strict=True):
                if o == order:
                    own[np.searchsorted(keys, _unpacked_keys(k.as_py()))] = _unpacked(t.as_py())
            at, one = np.empty(len(place), np.int64), np.empty(len(keys), np.int64)
            at[order_of] = place
            one[place] = order_of
            return keys, own, at, one

        word_keys, c_word, word, _ = totalled(1, mixed(words))
        # The state before a token is that of the word before it; a text begins at the start's state, whose count is the end's: it closes every text.
        start = len(word_keys)
        state = np.append(start, word[:-1])
        state[firsts] = start
        c_state = np.append(c_word, c_word[np.searchsorted(word_keys, mixed(np.array([END]))[0])])
        _, c_arc, arc, one = totalled(2, _pairs(words, contexts(words, sizes)))
        automaton = Automaton.of(c_word, c_state, c_arc, state[one], word[one], n, v, prior)
        weights = automaton.walk(state, word, arc)
        known = np.add.reduceat((c_word[word] > 0).astype(np.int64), firsts)
        columns = [x.column("doc_id").combine_chunks(), sizes, known, np.full(len(sizes), n), np.add.reduceat(automaton.root[word], firsts), np.add.reduceat(weights, firsts)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks)
    back = of_words.unionByName(_totals(rows, 2, n_blocks)).where("block is not null").select("block", "ord", "keys", "totals").repartition(parts, "block")
    dealt = rows.select("block", "doc_id", "text", F.col("learn").cast("int").alias("learn")).repartition(parts, "block")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(traverse, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
