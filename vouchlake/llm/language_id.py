"""Language identification in two levels.

A linear support vector machine per language family (one against the rest) decides the family; within it,
one machine for each pair of its languages votes. All work on the same features: byte trigrams of the
lower-cased text, hashed to `DIMS` counts, square-rooted and scaled to length one.

The machines are fitted on a bounded sample of the learning rows: `sample_docs` texts in all, shared equally by all
languages (`per_language` each at most, one at least), by hash of id and text. Of a text over `sample_bytes` a stretch of `stretch`
characters is learned, its place by hash. No language is left out, whatever the length of its texts. Prediction reads every
whole text.

Families come from `FAMILIES`; a language it does not list is a family of its own.

Defined results: null texts and texts without a letter (a character of Unicode's category L; number signs are none)
are `und` with score 0; with no learning row all are `und`; repeated rows get equal results; other columns are ignored. Equal votes go to the pair margin's
sum, then to the first language in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, written

DIMS = 4096
LETTER = regex.compile(r"\p{L}")
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
}
FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs}
FIELDS = "lang_pred string, score double, family string"


def vector(text: str) -> np.ndarray:
    a = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = ((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    x = np.sqrt(np.bincount(h, minlength=DIMS).astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine: squared hinge loss, classes weighted equally, Nesterov's descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        grad = -2 * (x.T @ (share * y * gap)) + decay * ahead
        new = ahead - 0.25 * grad
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class Model:
    langs: dict[str, list[str]]  # of each family
    families: list[str]
    by_family: np.ndarray  # families x (DIMS + 1)
    pairs: dict[str, list[tuple[int, int]]]
    by_pair: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        if not text or not self.families or not LETTER.search(text):
            return "und", 0.0, None
        x = np.append(vector(text), np.float32(1))
        margins = self.by_family @ x
        k = int(np.argmax(margins))
        sure = 1.0 if len(self.families) == 1 else _chance(margins[k])
        family = self.families[k]
        langs = self.langs[family]
        if len(langs) == 1:
            return langs[0], sure, family
        votes, sums = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), m in zip(self.pairs[family], self.by_pair[family] @ x, strict=True):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = max(range(len(langs)), key=lambda i: (votes[i], sums[i], -i))
        own = [m if i == best else -m for (i, j), m in zip(self.pairs[family], self.by_pair[family] @ x, strict=True) if best in (i, j)]
        return langs[best], sure * _chance(min(own)), family


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * np.clip(margin, -10, 10))))


def fit(texts: list[str], langs: list[str]) -> Model:
    of: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        of.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = sorted(of)
    x = np.stack([vector(t) for t in texts]) if texts else np.zeros((0, DIMS), np.float32)
    y = np.array(langs)
    family = np.array([FAMILY.get(a, a) for a in langs])
    side = lambda mask: np.where(mask, 1, -1).astype(np.float32)
    by_family = np.stack([machine(x, side(family == f)) for f in families]) if len(families) > 1 else np.zeros((len(families), DIMS + 1), np.float32)
    pairs = {f: [(i, j) for i in range(len(of[f])) for j in range(i + 1, len(of[f]))] for f in families}
    by_pair = {}
    for f in families:
        rows = [np.isin(y, [of[f][i], of[f][j]]) for i, j in pairs[f]]
        by_pair[f] = np.stack([machine(x[r], side(y[r] == of[f][i])) for r, (i, _) in zip(rows, pairs[f], strict=True)]) if rows else np.zeros((0, DIMS + 1), np.float32)
    return Model(of, families, by_family, pairs, by_pair)


def train(docs: DataFrame, may_learn: Column, per_language: int = 300, sample_docs: int = 9600, sample_bytes: int = 30_000, stretch: int = 10_000) -> Model:
    """A model from text and lang of the rows that may_learn allows: at most per_language texts of each language, sample_docs in all (or one of each language); of texts over sample_bytes a stretch."""
    first = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - stretch + 1)).cast("int") + 1
    cut = F.when(F.octet_length("text") <= sample_bytes, F.col("text")).otherwise(F.substring("text", first, F.lit(stretch)))
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "lang", cut.alias("text"))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang_counts")
    each = max(1, min(per_language, sample_docs // max(1, counts.count())))
    # A filter on the hash leaves about twice what is taken of each language, so that no task ranks a whole one.
    h = F.xxhash64("doc_id", "text")
    near = rows.join(F.broadcast(counts) if counts.count() <= sample_docs else counts, "lang").where(F.pmod(F.xxhash64(h), F.lit(2**30)) < F.ceil(F.lit(2**31 * each) / F.col("n")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id")))
    got = ranked.where(F.col("rank") <= each).select("lang", "text").toPandas().sort_values(["lang", "text"])
    return fit(list(got["text"]), list(got["lang"]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and family of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs) * DIMS floats

    return over_texts(docs, lambda: sent.value.predict, FIELDS)
