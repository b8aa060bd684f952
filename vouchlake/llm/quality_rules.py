"""Quality rules: fixed counts, and the divergence of a text's histograms from language references.

Two histograms describe a text: bytes by character class, and words by the commonest words of a language.
The same histograms, summed over all documents of a language, are that language's reference. A text's
distance to a reference is the Jensen-Shannon distance (base 2, from 0 to 1) of each histogram; it fails
where, for every language, one of them is over its threshold. Short texts have noisy histograms, so each has a
guard of its own: the word histogram counts from `least_words` words on, the class histogram from `least_chars`
bytes. Where neither counts, the verdict is the base rule's.

References come from all documents and all languages, by counts summed in each task before the shuffle; only the
`common` words of each language reach the driver, in one pass. A reference is `common` counts, eight classes and a
total, so many languages are no burden.

Defined results: a null text has no word and fails the base rule, as every text of under 50 words does; a
null lang is left out of the references; with no reference at all the verdict is the base rule's; repeated
rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CLASSES = 8


def _class_of_byte() -> np.ndarray:
    """Small letters, capitals, digits, white space, stops, symbols, other ASCII, first bytes of longer characters; following bytes: none."""
    of = np.full(256, 6)
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    for chars, k in ((SPACE, 3), (".,;:!?'\"()-", 4), (SYMBOLS, 5)):
        of[[ord(c) for c in chars]] = k
    of[0xC0:] = 7
    of[0x80:0xC0] = CLASSES
    return np.eye(CLASSES + 1)[of][:, :CLASSES]


BYTE_CLASS = _class_of_byte()


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ BYTE_CLASS


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis."""
    p, q = p / max(p.sum(), 1e-12), q / np.maximum(q.sum(-1, keepdims=True), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.sqrt(np.clip((kl(np.broadcast_to(p, m.shape)) + kl(q)) / 2, 0, 1))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    threes = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(threes)) < len(threes):
        n = Counter(threes)
        upto = 0
        for i, t in enumerate(threes):
            if n[t] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass
class References:
    langs: list[str]
    classes: np.ndarray  # languages x CLASSES
    words: list[list[bytes]]  # the common words of each language
    counts: np.ndarray  # languages x (common + 1): the last is all other words

    def __post_init__(self) -> None:
        self.places: dict[bytes, list[tuple[int, int]]] = {}  # of a word: languages, and its place in theirs
        for k, own in enumerate(self.words):
            for i, w in enumerate(own):
                self.places.setdefault(w, []).append((k, i))

    def class_distances(self, raw: bytes) -> np.ndarray:
        return distance(class_counts(raw), self.classes)

    def word_distances(self, words: list[bytes]) -> np.ndarray:
        n = Counter(words)
        own = np.zeros(self.counts.shape)
        for w in n.keys() & self.places.keys():
            for k, i in self.places[w]:
                own[k, i] = n[w]
        own[:, -1] = len(words) - own.sum(1)
        return distance(own, self.counts)


@dataclass
class Rules:
    most_class: float = 0.23
    most_word: float = 0.58
    least_chars: int = 200
    least_words: int = 80

    def verdict(self, refs: References | None, raw: bytes, words: list[bytes]) -> tuple[bool, str | None, float | None, float | None]:
        """Kept, the nearest language and the distances to it that count."""
        by_class, by_word = len(raw) >= self.least_chars, len(words) >= self.least_words
        if refs is None or not refs.langs or not (by_class or by_word):
            return True, None, None, None
        c = refs.class_distances(raw) if by_class else np.zeros(len(refs.langs))
        w = refs.word_distances(words) if by_word else np.zeros(len(refs.langs))
        k = int(np.argmin(np.maximum(c / self.most_class, w / self.most_word)))
        return bool(c[k] <= self.most_class and w[k] <= self.most_word), refs.langs[k], float(c[k]) if by_class else None, float(w[k]) if by_word else None


def references(docs: DataFrame, common: int = 150) -> References | None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[Counter, np.ndarray]] = {}
        held = 0

        def flushed() -> pd.DataFrame:
            parts = [pd.DataFrame({"lang": a, "kind": "w", "key": [str(k, "utf-8", "replace") for k in n], "n": list(n.values())}) for a, (n, _) in seen.items()]
            return pd.concat(parts + [pd.DataFrame({"lang": a, "kind": "c", "key": [str(i) for i in range(CLASSES)], "n": c.astype(int)}) for a, (_, c) in seen.items()])

        for x in batches:
            for lang, text in zip(x["lang"], x["text"], strict=True):
                raw = text.encode("utf-8", "replace")
                n, c = seen.get(lang) or (Counter(), np.zeros(CLASSES))
                before = len(n)
                n.update(raw.lower().split())
                seen[lang] = (n, c + class_counts(raw))
                held += len(n) - before
                if held > 300_000:  # a task's memory is bounded
                    yield flushed()
                    seen, held = {}, 0
        if seen:
            yield flushed()

    counts = docs.select("lang", "text").where("lang is not null and text is not null").mapInPandas(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = written(counts, "quality_counts")
    # Spark keeps each task's first words of a language before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counts.where("kind = 'w'").withColumn("rank", rank).where(F.col("rank") <= common).select("lang", "rank", "key", "n").collect()
    totals = counts.groupBy("lang").pivot("kind", ["w"]).agg(F.sum("n")).collect()
    langs = sorted(r["lang"] for r in totals)
    if not langs:
        return None
    at = {a: i for i, a in enumerate(langs)}
    words: list[list[bytes]] = [[] for _ in langs]
    table, classes = np.zeros((len(langs), common + 1)), np.zeros((len(langs), CLASSES))
    for r in sorted(top, key=lambda r: r["rank"]):
        table[at[r["lang"]], len(words[at[r["lang"]]])] = r["n"]
        words[at[r["lang"]]].append(r["key"].encode())
    for r in totals:
        table[at[r["lang"]], -1] = (r["w"] or 0) - table[at[r["lang"]]].sum()
    for r in counts.where("kind = 'c'").collect():
        classes[at[r["lang"]], int(r["key"])] = r["n"]
    return References(langs, classes, words, table)


def judge(docs: DataFrame, refs: References | None, rules: Rules = Rules()) -> DataFrame:
    """The counts and the verdict of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(refs)  # common + CLASSES numbers a language

    def make():
        refs = sent.value

        def of(text: str | None) -> tuple:
            text = text or ""
            raw = text.encode("utf-8", "replace")
            words = raw.split()
            counts = base_counts(text, words)
            failed = len(words) < 50 or 100 * counts[3] > 50 * len(words)
            verdict = (False, None, None, None) if failed else rules.verdict(refs, raw, raw.lower().split())
            return len(words), *counts, failed, *verdict

        return of

    return over_texts(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double")
