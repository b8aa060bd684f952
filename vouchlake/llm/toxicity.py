"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of its own, sigmoid(bias + sum of its
distinct words' weights), and the document's is their noisy-or, 1 - prod(1 - p). Only document labels are known;
the likelihood of the noisy-or is maximised, so that the weights move to the sentences that explain the
label, and the same model then points at the offending sentences.

Clean sentences have a small probability each, and a long clean text has many of them. So a text of n
sentences has a leak, the hazard -log(1 - p) that every sentence may have for nothing: the least q with which n
clean sentences have an expected excess hazard of at most `allowed`. It is 0 for texts of ordinary length, and
is learned from the clean texts of the sample that the weights clear. Only the hazard over the leak adds up.

The weights are fitted on a bounded sample of the labelled documents (`sample_docs` per class by hash of the id,
and `sample_bytes` per class), long ones among them: of a clean text a stretch of `stretch` characters is
enough, since each part of a clean text is clean; toxic texts are taken whole where the bytes last, as the
sentence that makes them toxic may be anywhere. Scoring reads every whole text, one Arrow batch at a time.

Defined results: null or empty texts have no sentence, score 0 and no worst sentence; repeated rows get
equal scores; with no labelled document of either class every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, over_texts, sliced

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"
CLEAR = -log1p(-0.3)  # a text of less hazard is taken as clean
FIELDS = "score double, worst_score double, worst_start long, worst_end long, toxic_sentences array<struct<start:long,end:long,score:double>>"


def words(sentence: str) -> list[str]:
    return [w for x in sentence.lower().split() if (w := x.strip(EDGES))]


def features(word: str) -> list[str]:
    """The word and its beginnings of four and five letters (marked ^): inflected insults share them."""
    return [word, f"^{word[:4]}", f"^{word[:5]}"] if len(word) > 4 else [word]


class WordWeights(dict):
    """The summed weight of a word's features, kept for reuse where it is no longer than `longest`; emptied when it holds `most`."""

    def __init__(self, weights: dict[str, float], most: int = 200_000, longest: int = 64):
        super().__init__()
        self.weights, self.most, self.longest = weights, most, longest

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        word, get = token.strip(EDGES), self.weights.get
        z = sum(get(f, 0.0) for f in features(word)) if word else 0.0
        if len(token) <= self.longest:
            self[token] = z
        return z


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if not m.group().isspace()]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    leaks: tuple[float, ...] = ()  # of texts of 1, 2, 4, 8, ... sentences

    def __post_init__(self) -> None:
        self.by_word = WordWeights(self.weights)

    def sentence(self, text: str) -> float:
        z = self.bias + sum(map(self.by_word.__getitem__, set(text.lower().split())))  # a repeated word counts once
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, z))))

    def leak(self, n: int) -> float:
        return float(np.interp(log(n, 2), range(len(self.leaks)), self.leaks)) if n and self.leaks else 0.0

    def document(self, text: str | None, mark: float = 0.3) -> tuple[float, float, int, int, list]:
        """Noisy-or of the sentences' hazards over the leak; the worst sentence; all at or above `mark`."""
        none, worst, hits = 0.0, (0.0, 0, 0), []
        spans = sentences(text or "")
        leak = self.leak(len(spans))
        for a, b in spans:
            p = self.sentence(text[a:b])
            none += min(0.0, log1p(-p) + leak)
            if p > worst[0]:
                worst = (p, a, b)
            if p >= mark:
                hits.append((a, b, p))
        return min(1.0, max(0.0, -expm1(none))), worst[0], worst[1], worst[2], hits


def fit(texts: list[str], labels: list[int], most_words: int = 4000, least_docs: int = 3, rounds: int = 250, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Weights by Adam on the likelihood of the noisy-or. Features of at least `least_docs` documents, the `most_words` that differ most between the classes."""
    if len(set(labels)) < 2:
        return Model(-30.0, {})
    one: dict[str, str] = {}  # a feature is held once, however often it occurs
    bags = [[sorted({one.setdefault(f, f) for w in words(t[a:b]) for f in features(w)}) for a, b in sentences(t)] for t in texts]
    by = (Counter(), Counter())
    for bag, y in zip(bags, labels, strict=True):
        by[y].update({w for s in bag for w in s})
    n = [labels.count(0), labels.count(1)]
    seen = [w for w in by[0].keys() | by[1].keys() if by[0][w] + by[1][w] >= least_docs]
    # How far a word's share of toxic documents stands from its share of the others, in standard errors.
    def apart(w: str) -> float:
        share = (by[0][w] + by[1][w]) / sum(n)
        return abs(by[1][w] / n[1] - by[0][w] / n[0]) / max(1e-9, (share * (1 - share) * (1 / n[0] + 1 / n[1])) ** 0.5)

    used = {w: i for i, w in enumerate(sorted(sorted(seen), key=apart, reverse=True)[:most_words])}
    doc, sent, feature, n_sent = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            doc.append(d)
            for w in s:
                if (i := used.get(w)) is not None:
                    sent.append(n_sent)
                    feature.append(i)
            n_sent += 1
    doc, sent, feature = np.array(doc, np.int64), np.array(sent, np.int64), np.array(feature, np.int64)
    y = np.array(labels, float)
    x = np.zeros(len(used) + 1)
    x[-1] = -5.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        z = np.clip(x[-1] + np.bincount(sent, x[feature], n_sent), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        some = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d z = p * (y * (1 - some) / some - (1 - y)), from d log(1 - p) / d z = -p.
        g = -p * (y * (1 - some) / some - (1 - y))[doc]
        grad = np.append(np.bincount(feature, g[sent], len(used)), g.sum()) / len(y)
        grad[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    z = np.clip(x[-1] + np.bincount(sent, x[feature], n_sent), -30, 30)
    hazard = np.log1p(np.exp(z))
    cleared = (y == 0) & (np.bincount(doc, hazard, len(y)) < CLEAR)
    return Model(float(x[-1]), {w: float(x[i]) for w, i in used.items() if abs(x[i]) > 1e-3}, leaks(hazard[cleared[doc]]))


def leaks(clean: np.ndarray, allowed: float = 0.05, doublings: int = 25) -> tuple[float, ...]:
    """For 1, 2, 4, ... sentences the least q where their expected hazard over q, by the hazards of clean sentences, is at most `allowed`."""
    h = np.sort(clean)[::-1]
    if not len(h):
        return ()
    upto = np.cumsum(h)
    k = np.arange(1, len(h) + 1)
    over = (upto - k * h) / len(h)  # the mean excess over h[k - 1], rising from 0
    out = []
    for d in range(doublings):
        most = allowed / 2**d
        i = int(np.searchsorted(over, most, "right"))  # h[i - 1] has at most that excess; between it and h[i] it is linear
        out.append(max(0.0, float((upto[i - 1] - most * len(h)) / i)))
    return tuple(out)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_docs: int = 2500, sample_bytes: int = 10_000_000, stretch: int = 60_000) -> Model:
    """A model from documents and labels(doc_id, toxic); may_learn: a predicate on doc_id. The sample is at most sample_docs texts and sample_bytes of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(may_learn)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [hash_sample(known.where(F.col("toxic") == c), n.get(c, 0), sample_docs, "doc_id") for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # bounded by 2 * sample_docs ids
    first = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - stretch + 1)).cast("int") + 1
    cut = F.when(F.col("toxic") == 0, F.substring("text", first, F.lit(stretch))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", cut.alias("text"))
    sizes = rows.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size")).select("doc_id", "toxic", "size", F.xxhash64("doc_id").alias("h")).collect()
    left, picked = {0: sample_bytes, 1: sample_bytes}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            picked.append((r["doc_id"],))
    if not picked:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long")
    got = rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return fit(list(got["text"]), [int(t) for t in got["toxic"]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, the worst sentence and the offending ones, for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.leaks))  # bounded by fit's most_words

    def make():
        document = Model(*sent.value).document

        def of(text: str | None) -> tuple:
            score, worst, a, b, hits = document(text)
            return score, worst, a, b, [{"start": a, "end": b, "score": p} for a, b, p in hits]

        return of

    return over_texts(docs, make, FIELDS)


def keep_below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.leaks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = Model(*sent.value).document
        for b in sliced(batches):
            yield b.filter(pa.array([document(t)[0] < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
