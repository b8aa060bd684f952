"""Order-preserving packing of documents into token sequences.

The documents of a task, in order, are one stream of tokens, each document closed by an end id. Dynamic
programming chooses where to cut the stream into sequences of at most `length` tokens, at the least sum of
padding and of penalties for cuts: none at a document's end, small at a sentence's, larger inside one. With
positions p and best costs f, f(j) = length - p(j) + penalty(j) + min(f(i) + p(i)) over i with
p(j) - p(i) <= length; the minimum over that sliding range is the head of a monotone queue, so each candidate
is pushed and popped once. Stretches without a sentence end get candidates every `spacing` tokens.

A stream is packed in runs of at least `run_tokens` tokens and whole documents, which bounds a task's memory
by its longest document. Only a run's last sequence has no successor to share with: it is padded, or cut
into powers of two (which need no padding), whichever costs less.

There is no shuffle: a task packs its own partition. Sequence ids are the partition's number and a count.

Defined results: a null or empty text is its end id alone; repeated rows are packed again; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import sliced
from .tokens import Encoder, shared

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


@dataclass(frozen=True)
class Costs:
    length: int = 1024
    sentence: float = 2.0
    inside: float = 14.0
    spacing: int = 24
    run_tokens: int = 400_000


def candidates(ends: np.ndarray, doc_ends: np.ndarray, total: int, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending, and their penalties. The first is 0, the last is total."""
    may = np.zeros(total + 1, bool)
    may[ends] = may[doc_ends] = may[[0, total]] = True
    at = np.flatnonzero(may)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > costs.spacing)
    # Each wide gap's further candidates: its start plus 1, 2, ... times the spacing, up to before its end.
    n = (gaps[wide] - 1) // costs.spacing
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    may[np.repeat(at[wide], n) + step * costs.spacing] = True
    every = np.flatnonzero(may)
    penalty = np.full(len(every), costs.inside)
    penalty[np.searchsorted(every, ends)] = costs.sentence
    penalty[np.searchsorted(every, doc_ends)] = 0.0
    penalty[-1] = 0.0
    return every, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, costs: Costs) -> list[int]:
    """The ends of the sequences at the least cost."""
    p, pen, length = at.tolist(), penalty.tolist(), costs.length
    n = len(p)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f + p, index), both ascending
    for j in range(1, n):
        low = p[j] - length
        while p[queue[0][1]] < low:
            queue.popleft()
        g, i = queue[0]
        f = length - p[j] + pen[j] + g
        best[j], back[j] = f, i
        g = f + p[j]
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    # The last sequence: padded, or in powers of two.
    last, total = n - 1, p[-1]
    choice, least, split = back[last], float("inf"), False
    i = last - 1
    while i >= 0 and total - p[i] <= length:
        size = total - p[i]
        pad, parts = length - size if size & (size - 1) else 0, costs.inside * (size.bit_count() - 1)
        if best[i] + min(pad, parts) < least:
            least, choice, split = best[i] + min(pad, parts), i, parts < pad
        i -= 1
    out, rest = [total], total - p[choice]
    if split:
        at_, ends = p[choice], []
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at_ += 1 << bit
                ends.append(at_)
        out = ends[::-1]
    j = choice
    while j > 0:
        out.append(p[j])
        j = back[j]
    return out[::-1]


class Packer:
    def __init__(self, costs: Costs, encoder: Encoder, first_id: int):
        self.costs, self.encoder, self.next_id = costs, encoder, first_id
        self.ends = encoder.ends_sentence()
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.waiting = 0

    def add(self, doc_id: int | None, text: str | None) -> pd.DataFrame | None:
        ids = np.append(self.encoder.ids(text) if text else np.zeros(0, "<u4"), np.uint32(0)).astype("<u4")
        self.docs.append((doc_id, ids))
        self.waiting += len(ids)
        return self.pack() if self.waiting >= self.costs.run_tokens else None

    def pack(self) -> pd.DataFrame | None:
        if not self.docs:
            return None
        stream = np.concatenate([ids for _, ids in self.docs])
        sizes = np.array([len(ids) for _, ids in self.docs])
        doc_ends = np.cumsum(sizes)
        doc_starts = doc_ends - sizes
        at, penalty = candidates(np.nonzero(self.ends[stream])[0] + 1, doc_ends, len(stream), self.costs)
        sequence_ends = np.array(cuts(at, penalty, self.costs))
        sequence_starts = np.append(0, sequence_ends[:-1])
        starts = np.union1d(doc_starts, sequence_starts)
        ends = np.append(starts[1:], len(stream))
        doc = np.searchsorted(doc_starts, starts, "right") - 1
        sequence = np.searchsorted(sequence_starts, starts, "right") - 1
        raw = memoryview(stream.tobytes())
        rows = pd.DataFrame(
            {
                "doc_id": pd.array([self.docs[d][0] for d in doc], "Int64"),
                "start": starts - doc_starts[doc],
                "length": ends - starts,
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
                "doc_tokens": sizes[doc],
                "sequence_id": self.next_id + sequence,
                "offset": starts - sequence_starts[sequence],
                "sequence_length": (sequence_ends - sequence_starts)[sequence],
            }
        )
        self.next_id += len(sequence_ends)
        self.docs, self.waiting = [], 0
        return rows


def pack(docs: DataFrame, costs: Costs = Costs(), vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence."""

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(costs, shared(vocabulary, ranks), TaskContext.get().partitionId() << 32)
        for x in sliced(batches):
            for doc_id, text in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist(), strict=True):
                if (rows := packer.add(doc_id, text)) is not None:
                    yield pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)
        if (rows := packer.pack()) is not None:
            yield pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
