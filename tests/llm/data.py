"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words array<string>, shard int, key string"
BIG = 2**60 + 1  # no float holds it


def prose(n, seed=0, v=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = f"w{r.randrange(v)}x"
        out.append(w + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


def awkward():
    a, b = prose(120, 1), prose(80, 2)
    near = a.split(" ")
    near[60] = "changed"
    texts = [
        (BIG, a), (2, a), (2, a), (3, " ".join(near)), (4, b), (None, b), (None, prose(70, 3)), (5, None), (None, None), (6, ""), (7, ""),
        (8, "   \n\t "), (9, "123 456 !!"), (10, "é"), (11, prose(9000, 4)), (12, "x" * 50_000), (13, "A b c   日本語 <|endoftext|> z"), (14, "one two three"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), 0.5, ["q"], 7, "k") for k, (i, t) in enumerate(texts)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
