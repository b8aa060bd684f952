"""Byte-level BPE and alignment against the tokenizers' own libraries and brute force, over awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.data import awkward, documents, prose
from vouchlake.llm import alignment, byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "  ", "\n", "a\n \nb", "a \n b", "\t \tb", "a  b", " lead", "trail ", "tab\tand  two", "it's we'll I'd", "x  y 　z", "日本語 テスト 123,456", "é \U0001f600\U0001f1e9\U0001f1ea",
    "<|endoftext|> <s> </s> <0x41>", "under▁score", "A" * 700, "ab" * 300 + "cd" * 100, "=" * 130 + " " * 70 + "-" * 9, "\x00\x01\x7f \x1c \x85  x", "ﬁ ℌ ﷺ", "﻿start", "a\r\n\r\n b", "𝔘𝔫𝔦 ̈x",
]


def texts():
    r = random.Random(5)
    letters = "abcdefgh ABC \n\t  .,;'0123 éüñ 日本   "
    rows = awkward() + [(100 + i, t, None, None, 0, 0.0, [], 0, "") for i, t in enumerate(ODD)]
    return rows + [(500 + i, "".join(r.choice(letters) for _ in range(r.randrange(1, 60))), None, None, 0, 0.0, [], 0, "") for i in range(300)]


def test_ids_are_the_library_s_and_decode_to_the_text(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    rows = [x for x in texts() if x[0] != 12 and x[1] != "x" * 50_000]
    got = byte_bpe.encode(documents(spark, rows)).select("doc_id", "ids", byte_bpe.decoded(F.col("ids")).alias("raw"), "packed").collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((x["doc_id"], tuple(x["ids"]), bytes(x["raw"])) for x in got) == want
    assert all(bytes(x["packed"]) == np.array(x["ids"], "<u4").tobytes() for x in got)


def test_a_word_of_thousands_of_bytes(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    r = random.Random(1)
    words = ["x" * 3000, "".join(r.choice("etaoin") for _ in range(2000)), "日本語中文" * 200]
    got = spark.createDataFrame([(w.encode(),) for w in words], "word binary").select("word", byte_bpe.encoded(F.col("word"), RANKS).alias("ids")).collect()
    assert all(x["ids"] == library.encode_ordinary(bytes(x["word"]).decode()) for x in got)


def test_every_entry_of_the_rank_file_is_one_word_or_its_own_merges(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    words = random.Random(3).sample(sorted(b for b in byte_bpe.ranks_of(RANKS) if len(b) > 2), 300)
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    got = spark.createDataFrame([(w,) for w in joined], "word binary").select("word", byte_bpe.encoded(F.col("word"), RANKS).alias("ids")).collect()
    assert all(x["ids"] == library._encode_single_piece(bytes(x["word"])) for x in got)


def test_blocks_have_their_own_numbers(spark, monkeypatch):
    docs = documents(spark, [(i, prose(40, i, v=3000), None, None, 0, 0.0, [], 0, "") for i in range(60)])
    want = {x["doc_id"]: x["ids"] for x in byte_bpe.encode(docs).collect()}
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 20)
    assert {x["doc_id"]: x["ids"] for x in byte_bpe.encode(docs.repartition(3)).collect()} == want


def test_empty_tables(spark):
    none = documents(spark, [])
    assert byte_bpe.encode(none).collect() == [] and alignment.align(none).collect() == []


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_a = {i: w for w, i in byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or any(b"".join(p) != (" " + t).encode() for p in ([of_a[i] for i in x], [of_b(i) for i in y])):
            found.append((doc, [], [], [], ""))
            continue
        ends, at = {}, 0
        for k, i in enumerate(x):
            at += len(of_a[i])
            ends[at] = k
        links, groups, i0, j0, at = [], [], 0, 0, 0
        for j, i in enumerate(y):
            at += len(of_b(i))
            if at in ends:
                links.append((x[ends[at]], i))
                groups.append(",".join(map(str, x[i0 : ends[at] + 1])) + "|" + ",".join(map(str, y[j0 : j + 1])))
                i0, j0 = ends[at] + 1, j + 1
        counts.update(links)
        found.append((doc, x, y, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, i), n in counts.items():
        best[i] = max(best[i], n)
    return Counter((doc, len(x), len(y), len(k), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), digest) for doc, x, y, k, digest in found)


def test_alignment_matches_brute_force(spark, monkeypatch):
    rows = texts() * 2
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)  # several blocks, and salted stripes
    monkeypatch.setattr(alignment, "SALT_BLOCKS", 2)
    got = alignment.align(documents(spark, rows).repartition(3)).collect()
    assert Counter(tuple(x) for x in got) == brute_alignment([(x[0], x[1]) for x in rows])
    assert any(x["n_a"] == 0 and x["doc_id"] is not None and x["doc_id"] >= 100 for x in got)  # U+2581
