"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with awkward rows."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import BIG, awkward, documents, prose
from vouchlake.llm import chat_format, decontamination, language_id, lm_scoring, near_duplicates, packing, quality_rules, secrets, sharding, tokens, toxicity
from vouchlake.llm.common import WordHashes, fold
from vouchlake.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
IDS = Counter(r[0] for r in awkward())


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 1 ------------------------------------------------------------------ toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        s = [prose(12, seed * 10_000 + i * 7 + k) + "." for k in range(6)]
        if bad:
            k = r.randrange(6)
            s[k] = "you " + r.choice(["scumbag", "scumlike", "vile"]) + " " + s[k]
        rows.append((i, " ".join(s), "en", "s", 0, 0.0, [], 0, ""))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_the_sentence_from_document_labels(spark):
    rows, labels = toxic_rows(400, 1)
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fold(F.col("doc_id"), 4) != 2)
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    text = {r[0]: r[1] for r in rows}
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    for r in held:
        if r["score"] >= 0.3 and r["doc_id"] % 5 == 0:
            assert re.search("scum|vile", text[r["doc_id"]][r["worst_start"] : r["worst_end"]])


def test_toxicity_awkward_rows(spark):
    model = toxicity.Model(-12.0, {"vile": 15.0})
    out = toxicity.score(documents(spark), model)
    assert ids(out) == IDS
    empty = [r for r in out.collect() if r["doc_id"] in (5, 6, 7, 8)]
    assert all(r["score"] == 0 and r["toxic_sentences"] == [] for r in empty)
    assert toxicity.score(documents(spark, []), model).count() == 0
    none = toxicity.train(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert none.document("anything vile")[0] < 1e-9
    kept = toxicity.keep_below(documents(spark), model, 0.3)
    assert kept.columns == documents(spark).columns and ids(kept)[None] == 3


def test_toxicity_of_long_texts(spark):
    rows, labels = toxic_rows(400, 1)
    long = " ".join(r[1] for r in rows if r[0] % 5)  # a labelled text over 60,000 bytes is learned from
    assert len(long) > 60_000
    rows, labels = rows + [(1000, long + " you zorkling. " + long, "en", "s", 0, 0.0, [], 0, "")], labels + [(1000, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), table, F.lit(True))
    clean = [r[1] for r in toxic_rows(400, 3)[0] if r[0] % 5 and model.document(r[1])[0] < 0.05]
    for size in (200_000, 1_000_000, 5_000_000):
        text = " ".join(clean * (size // sum(map(len, clean)) + 1))[:size]
        assert model.document(text)[0] < 0.3, size
        score, _, a, b, _ = model.document(text[: size // 2] + ". you vile scumbag. " + text[size // 2 :])
        assert score >= 0.3, size
    seen = []
    kept, toxicity.fit = toxicity.fit, lambda texts, labels: seen.extend(texts) or kept(texts, labels)
    try:
        toxicity.train(documents(spark, rows), table, F.lit(True))
    finally:
        toxicity.fit = kept
    assert rows[-1][1] in seen


def test_toxicity_fit_is_near_the_least_loss():
    """The loss of document labels, in plain Python: no small change of a weight betters the fit's."""
    rows, labels = toxic_rows(150, 5)
    texts, y = [x[1] for x in rows], [x[2] for x in labels]
    decay = 1e-4
    model = toxicity.fit(texts, y, most_words=60, rounds=600, decay=decay)
    bags = [[{f for w in toxicity.words(t[a:b]) for f in toxicity.features(w)} for a, b in toxicity.sentences(t)] for t in texts]

    def loss(bias, weights):
        out = sum(decay / 2 * w * w for w in weights.values())
        for bag, label in zip(bags, y):
            none = sum(math.log1p(-1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in s))))) for s in bag)
            out -= (math.log(max(1e-9, -math.expm1(none))) if label else none) / len(y)
        return out

    least = loss(model.bias, model.weights)
    assert least < 0.05
    r = random.Random(1)
    for f in r.sample(sorted(model.weights), 12):
        for by in (-0.3, 0.3):
            assert loss(model.bias, {**model.weights, f: model.weights[f] + by}) > least - 2e-4, f
    assert min(loss(model.bias + by, model.weights) for by in (-0.3, 0.3)) > least - 2e-4


def test_toxicity_conflicting_and_null_labels(spark):
    rows, labels = toxic_rows(200, 6)
    odd = [(0, 1, 0), (None, 1, 1), (7, 1, None), (10**9, 1, 1)]  # a conflict counts as toxic; null ids, null labels and unknown ids are left out
    schema = "doc_id long, quality int, toxic int"
    seen = []
    kept, toxicity.fit = toxicity.fit, lambda texts, y: seen.append((texts, y)) or kept(texts, y)
    try:
        toxicity.train(documents(spark, rows), spark.createDataFrame(labels, schema), F.lit(True))
        toxicity.train(documents(spark, rows), spark.createDataFrame(labels + odd, schema), F.lit(True))
    finally:
        toxicity.fit = kept
    assert seen[0] == seen[1]


def test_noisy_or():
    m = toxicity.Model(-2.0, {"bad": 3.0})
    p = [1 / (1 + math.exp(2)), 1 / (1 + math.exp(-1))]
    assert m.document("Good one. Bad bad two!")[0] == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))


# 2 ------------------------------------------------------------------- secrets


def brute_base(text):
    a = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_patterns_match_brute_force():
    r = random.Random(5)
    parts = ["password", "PassWD", "secret", "token: secret = ", "api_key", "apikey", " : ", "=", '"', "'", " ", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "ſecret=abcdefghijklmnop", "\n", "xyzxyzxyzxyz"]
    scanner = secrets.Scanner()
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert scanner.spans(text)[0] == brute_base(text), text


def test_secret_novelty_and_awkward_rows(spark):
    scanner = secrets.Scanner()
    text = "Authorization header: bearer Zx8kQ2mV9pLr4TnW7yBc1HdJ and auth config_settings_value_1 here"
    assert [text[a:b] for a, k, b in scanner.spans(text)[1] if k == 3] == ["Zx8kQ2mV9pLr4TnW7yBc1HdJ"]
    repeated = "key Zx8kQ2mV9pLr4TnW7yBc1HdJ then auth Zx8kQ2mV9pLr4TnW7yBc1HdJ"
    assert [repeated[a:b] for a, k, b in scanner.spans(repeated)[1] if k == 3] == ["Zx8kQ2mV9pLr4TnW7yBc1HdJ"]  # its own copy does not explain it
    twice = "auth Zx8kQ2mV9pLr4TnW7yBc1HdJ, again auth Zx8kQ2mV9pLr4TnW7yBc1HdJ"
    assert len([1 for _, k, _ in scanner.spans(twice)[1] if k == 3]) == 2
    out = secrets.scan(documents(spark))
    assert ids(out) == IDS
    assert {r["base_sha256"] for r in out.collect() if r["doc_id"] in (5, 6)} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(documents(spark, [])).count() == 0
    rows = [(1, "my token=0123456789abcdef0123 ok", None, None, 5, 0.0, [], 0, ""), (2, None, None, None, None, 0.0, [], 0, "")]
    got = {r["doc_id"]: r for r in secrets.redact(documents(spark, rows)).collect()}
    assert got[1]["text"] == "my [SECRET] ok" and got[1]["n_chars"] == 14 and got[2]["text"] is None


def test_secret_recall_by_alphabet():
    r = random.Random(3)
    before = "def connect(user, host):\n    client = Client(host, port=8080)\n    config.load('settings.json')\n    "
    lower, base62 = "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = {(a, n): ["".join(r.choice(a) for _ in range(n)) for _ in range(60)] for a in (lower, base62) for n in (20, 40, 64)}
    made["uuid", 36] = [str(uuid.UUID(int=r.getrandbits(128), version=4)) for _ in range(60)]
    scanner = secrets.Scanner()
    for kind, values in made.items():
        found = 0
        for v in values:
            text = f'{before}JWT_SECRET_KEY = "{v}"\n    return client.get(user)\n'
            found += any((text[a:b], k) == (v, 3) for a, k, b in scanner.spans(text)[1])
        assert found >= 0.85 * len(values), kind


def test_every_secret_candidate_within_reach_is_measured():
    scanner, key = secrets.Scanner(), "q8x1z7k3p0w9v5m2t6r4"
    novel = lambda text: [text[a:b] for a, k, b in scanner.spans(text)[1] if k == 3]
    for text in (f"see SECRET_KEY={key} there", f"jwt_secret_value: {key}", f"MY_CREDENTIALS -> {key}", "signature" + " " * 44 + key):
        assert novel(text) == [key], text
    assert key in novel(f"auth config_settings_value_1 {key}")  # a harmless one before it


def test_secret_dictionary_of_the_corpus(spark):
    """Identifiers of all texts are learned, and explain a candidate that the fixed names do not."""
    rows = [(i, "call tenant_billing_ledger and fooBarBaz or HttpServer in retry_loop", None, None, 0, 0.0, [], 0, "") for i in range(5)] + [(9, None, None, None, None, 0.0, [], 0, "")]
    names = secrets.names_of(documents(spark, rows))
    assert all(x in names.split() for x in ("tenant_billing_ledger", "fooBarBaz", "HttpServer", "retry_loop")) and names.endswith(secrets.NAMES)
    assert secrets.names_of(documents(spark, [])) == secrets.NAMES
    text = "auth tenant_billing_ledger_v2 here"
    plain, primed = secrets.Scanner(), secrets.Scanner(names=names)
    assert plain.novelty("auth ", "tenant_billing_ledger_v2", " here") > 1.5 * primed.novelty("auth ", "tenant_billing_ledger_v2", " here")
    assert not [1 for _, k, _ in primed.spans(text)[1] if k == 3]
    odd = "token " + "a1" * 50_000 + " auth " + "9z" * 40  # very long runs
    assert all(b <= len(odd) for _, _, b in primed.spans(odd)[1])


# 3 ------------------------------------------------------------------- packing


def test_packing_is_a_partition_of_every_id(spark):
    rows = awkward() + [(100 + i, prose(60 + 37 * i % 900, i), None, None, 0, 0.0, [], 0, "") for i in range(150)]
    docs = documents(spark, rows).coalesce(2)
    out = packing.pack(docs, packing.Costs(run_tokens=20_000)).collect()
    encoder = Encoder()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for r in rows:
        own = np.append(encoder.ids(r[1]) if r[1] else [], 0).astype("<u4")
        same = [p for p in pieces[r[0]] if p["doc_tokens"] == len(own)]
        assert same
        for p in same:
            assert 0 <= p["start"] and p["start"] + p["length"] <= len(own)
        if IDS.get(r[0], 1) == 1:
            begins = sorted(p["start"] for p in same)
            assert begins[0] == 0 and sorted((p["start"], p["start"] + p["length"]) for p in same) == list(zip(begins, [*begins[1:], len(own)]))
            assert all(p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) for p in same)
    pad = 0
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        at = 0
        for p in s:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at == s[0]["sequence_length"]
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    total = sum(p["length"] for p in out)
    assert total == sum(len(encoder.ids(r[1])) + 1 if r[1] else 1 for r in rows) and pad < 0.03 * total
    assert packing.pack(documents(spark, [])).count() == 0


def test_cuts_are_the_cheapest():
    r = random.Random(2)
    for _ in range(60):
        costs = packing.Costs(length=16, sentence=2.0, inside=5.0, spacing=4)
        total = r.randrange(1, 60)
        ends = np.array(sorted(r.sample(range(1, total + 1), min(total, 5))))
        docs = np.array(sorted({*r.sample(range(1, total + 1), min(total, 2)), total}))
        at, pen = packing.candidates(ends, docs, total, costs)

        def cost(cut):
            c, a = 0.0, 0
            for b in cut[:-1]:
                c += costs.length - (b - a) + pen[list(at).index(b)]
                a = b
            n = cut[-1] - a
            return c + min(costs.length - n if n & (n - 1) else 0, costs.inside * (n.bit_count() - 1))

        # The best way to each candidate, over all ways to the candidates before it.
        best, least = {0: (0.0, [])}, math.inf
        for j in map(int, at[1:]):
            before = [i for i in best if j - i <= 16]
            if j == total:
                least = min(cost([*best[i][1], j]) for i in before)
            best[j] = min((best[i][0] + costs.length - (j - i) + pen[list(at).index(j)], [*best[i][1], j]) for i in before)
        got = packing.cuts(at, pen, costs)
        assert got[-1] == total and all(0 < b - a <= 16 for a, b in zip([0, *got], got))
        # The last sequence may have been split: some beginning of the cuts, then the rest in one, costs the least.
        heads = [got[:k] for k in range(len(got)) if total - [0, *got][k] <= 16 and set(got[:k]) <= set(at.tolist())]
        assert min(cost([*h, total]) for h in heads) == pytest.approx(least)


def test_very_long_runs_are_encoded_by_one_loaded_encoder():
    from tokenizers import Tokenizer

    fast = tokens.shared()
    assert tokens.shared() is fast and not hasattr(fast, "kept")  # loaded once a worker; holds nothing of the texts
    exact = Tokenizer.from_file(fast.vocabulary)
    for text in (" " * 300_000, "a" + " " * 1_100_000 + "b"):
        assert fast.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_token_ids_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, fast, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder(), random.Random(3)
    parts = ["a", "The", " ", " ", "  ", "\n", "\t", "é", "ß", "日", "don't", "12", ".", "!?", "<|endoftext|>", "\x1c", " ", " ", "😀", "x y z"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert fast.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


# 4 ------------------------------------------------------------------ LM scoring


def test_lm_scores_match_brute_force(spark):
    rows = awkward() + [(100 + i, prose(90, i, 60).replace("w1", "W1"), None, None, 0, 0.0, [], 0, "") for i in range(60)]
    out = lm_scoring.score(documents(spark, rows).repartition(3), fold(F.col("doc_id"), 7) != 2, prior=10.0).collect()
    word = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", lowered(r[1] or "")), "</s>"]) for r in rows]
    learn = [w for i, w in word if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    one = Counter(t for w in learn for t in w)
    two = Counter(p for w in learn for p in zip(["<s>", *w], w))
    n, v = sum(one.values()), len(one)
    one["<s>"] = one["</s>"]
    want = []
    for i, w in word:
        p = [(one[t] + 1) / (n + v + 1) for t in w]
        s = sum(math.log10((two[q] + 10 * b) / (one[q[0]] + 10)) for q, b in zip(zip(["<s>", *w], w), p))
        want.append((i, len(w), sum(one[t] > 0 for t in w), n, sum(map(math.log10, p)), s))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert lm_scoring.score(documents(spark, []), F.lit(True)).count() == 0


def test_lm_automaton_is_a_backoff_traversal():
    """Against a traversal in plain Python: a state, its arcs, a failure arc to the root, one word after the other."""
    r = random.Random(4)
    c_word = {w: r.randrange(0, 9) for w in range(12)}
    c_pair = {(a, b): r.choice([0, 0, 1, 3]) for a in range(13) for b in range(12)}
    c_state = {**c_word, 12: 5}
    total, distinct, prior = sum(c_word.values()), sum(n > 0 for n in c_word.values()), 4.0
    root = {b: math.log10((c_word[b] + 1) / (total + distinct + 1)) for b in c_word}
    arcs = {k: math.log10((n + prior * 10 ** root[k[1]]) / (c_state[k[0]] + prior)) for k, n in c_pair.items() if n}
    text, state, want = [r.randrange(12) for _ in range(300)], 12, []
    for w in text:
        want.append(arcs[state, w] if (state, w) in arcs else math.log10(prior / (c_state[state] + prior)) + root[w])
        state = w
    pairs = sorted(c_pair)
    place = {k: i for i, k in enumerate(pairs)}
    of = lambda xs: np.array(list(xs))
    made = lm_scoring.Automaton.of(of(c_word[w] for w in range(12)), of(c_state[w] for w in range(13)), of(c_pair[k] for k in pairs), of(a for a, _ in pairs), of(b for _, b in pairs), total, distinct, prior)
    states = [12, *text[:-1]]
    assert made.walk(of(states), of(text), of(place[k] for k in zip(states, text))).tolist() == pytest.approx(want)
    # A state's probabilities over the known words and an unknown one: what it saw, and its failure arc times the root's.
    every = sum(10 ** made.walk(np.full(12, 3), np.arange(12), of(place[3, b] for b in range(12))))
    root_sum = sum(10**x for x in root.values())
    assert every == pytest.approx((sum(c_pair[3, b] for b in range(12)) + prior * root_sum) / (c_state[3] + prior))


def test_lm_blocks_are_bounded_in_uneven_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    path = str(tmp_path / "uneven")
    same = (1, prose(30, 1), None, None, 0, 0.0, [], 0, "")  # one id and one text, again and again
    documents(spark, [same] * 1500).coalesce(1).write.parquet(path)
    for k in range(5):
        documents(spark, [(k, "a small file", None, None, 0, 0.0, [], 0, "")]).coalesce(1).write.mode("append").parquet(path)
    for by_file in (True, False):
        rows, n = lm_scoring._with_blocks(spark.read.parquet(path), F.lit(True), by_file)
        sizes = [x["n"] for x in rows.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
        assert sum(sizes) == 1500 * len(same[1]) + 5 * 12 and max(sizes) < 60_000 and len(sizes) <= n
    got = lm_scoring.score(spark.read.parquet(path), F.lit(True), by_file=True).collect()
    other = lm_scoring.score(spark.read.parquet(path), F.lit(True)).collect()
    assert len(got) == 1505 and Counter(map(repr, got)) == Counter(map(repr, other))


# 5 ----------------------------------------------------------------- language id

SAMPLES = {"en": "the of and that with this from have", "de": "der die und nicht eine schön über auch", "es": "el que los para una mañana está", "fr": "les que dans pour une été où très", "zz": "qwx zxq xqz wqx zzq"}


def test_language_id_held_out(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(SAMPLES[a].split()) for _ in range(40)), a, "s", 0, 0.0, [], 0, "") for i in range(300) for a in [sorted(SAMPLES)[i % 5]]]
    docs = documents(spark, rows)
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    got = language_id.predict(docs, model).collect()
    held = [x for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert sum(x["lang_pred"] == rows[x["doc_id"]][2] for x in held) >= 0.98 * len(held) and all(0 <= x["score"] <= 1 for x in got)
    odd = language_id.predict(documents(spark), model)
    assert ids(odd) == IDS
    assert {x["lang_pred"] for x in odd.collect() if x["doc_id"] in (5, 6, 8, 9)} == {"und"}
    assert "und" not in {x["lang_pred"] for x in odd.collect() if x["doc_id"] in (10, 13)}
    none = language_id.train(documents(spark, []), F.lit(True))
    assert {x["lang_pred"] for x in language_id.predict(documents(spark), none).collect()} == {"und"}


def test_language_votes_match_brute_force():
    r = np.random.default_rng(3)
    langs = ["aa", "bb", "cc", "dd"]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for k in range(60):
        w = r.normal(size=(6, language_id.DIMS + 1)).astype(np.float32)
        if k % 3 == 0:
            w[:] = 0  # all margins tie: each pair's first language wins it, then the first in the alphabet
        model = language_id.Model({"fam": langs, "one": ["zz"]}, ["fam", "one"], np.array([[0.0] * language_id.DIMS + [1.0], [0.0] * language_id.DIMS + [-1.0]], np.float32), {"fam": pairs, "one": []}, {"fam": w, "one": w[:0]})
        text = f"some text {k}"
        x = np.append(language_id.vector(text), np.float32(1))
        votes, sums = Counter(), Counter()
        for (i, j), row in zip(pairs, w):
            m = float(row @ x)
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = sorted(range(4), key=lambda i: (-votes[i], -sums[i], i))[0]
        got = model.predict(text)
        assert got[0] == langs[best] and got[2] == "fam" and 0 <= got[1] <= 1
    assert model.predict("² ½ 5")[0] == "und" and model.predict("ª")[0] != "und"


def test_language_id_keeps_every_language(spark):
    """Forty languages, more than any bound on texts a language leaves over ten of."""
    rows = [(40 * k + a, " ".join(f"{chr(97 + a % 26)}{chr(97 + a // 26)}{chr(97 + (k * j) % 26)}q" for j in range(30)), f"l{a:02d}", "s", 0, 0.0, [], 0, "") for k in range(12) for a in range(40)]
    model = language_id.train(documents(spark, rows), F.lit(True), sample_docs=200)
    assert sorted(x for xs in model.langs.values() for x in xs) == [f"l{a:02d}" for a in range(40)]
    got = [model.predict(r[1])[0] == r[2] for r in rows]
    assert sum(got) > 0.9 * len(got)


def test_a_language_of_long_texts_only_is_learned(spark):
    r = random.Random(6)
    fi, de = ["kissa", "talo", "yksi", "hyvaa", "paivaa", "olen"], ["der", "und", "nicht", "schon", "haus", "ich"]
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(fi, 6000), "fi", "s", 0, 0.0, [], 0, "") for i in range(30)] + [(100 + i, text(de, 60), "de", "s", 0, 0.0, [], 0, "") for i in range(200)]
    assert all(len(x[1]) > 31_000 for x in rows[:30])
    model = language_id.train(documents(spark, rows), F.lit(True))
    assert sorted(x for xs in model.langs.values() for x in xs) == ["de", "fi"]
    assert all(model.predict(x[1])[0] == x[2] for x in rows) and model.predict(text(fi, 20))[0] == "fi"


# 6 ----------------------------------------------------------------- chat format


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    r = random.Random(4)
    bits = ["</s>", "[INST]", "<~/s>", "<<SYS>>", "<|im_end|>", "<~|im_start|>", "ok", "\n", "~", "é日", "\\n", " "]
    rows = []
    for c in range(40):
        n = 700 if c == 3 else r.randrange(1, 12)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant", "assistant", "to\nol\\n", None])
            text = None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(30))) * (60 if r.random() < 0.05 else 1)
            rows.append((None if c == 5 else c, None if c == 7 and t == 2 else t, role, text))
    rows += [(8, 0, "user", "again")] * 3
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    win = chat_format.windows(df, budget=200, history=60)
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat_format.read_back(win).collect()}
    assert got == brute_chat(rows)
    encoder, sizes = Encoder(), defaultdict(list)
    for w in win.collect():
        turns = chat_format.parsed(w["text"])
        assert w["n_context"] + w["n_new"] == len(turns)
        tokens = len(encoder.ids(w["text"]))
        assert tokens == w["n_tokens"] and (tokens <= 200 or (w["n_new"] == 1 and w["n_context"] == 0)), (w["conv_id"], tokens)
        sizes[w["conv_id"]].append((w["segment"], w["window"], turns))
        if w["conv_id"] == 3 and (w["segment"], w["window"]) > (0, 0) and w["n_tokens"] <= 200 and w["n_context"]:
            assert turns[0][0] == "system"
    assert len(sizes[3]) > 5
    assert chat_format.read_back(chat_format.windows(df.limit(0))).count() == 0


def test_chat_with_odd_turn_numbers(spark):
    far = [(1, 10**12 * k - 5, "user" if k % 2 else "assistant", f"far {k}") for k in range(300)] + [(1, None, "system", "be brief")]
    same = [(2, 7, "assistant", f"same {k % 3}") for k in range(400)]
    large = [(3, 0, "system", "word " * 900)] + [(3, k, "assistant", f"short {k}") for k in range(1, 21)]
    null = [(None, None, None, None)] * 3
    df = spark.createDataFrame(far + same + large + null, "conv_id long, turn long, role string, text string")
    win = chat_format.windows(df, budget=200, history=60).cache()
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat_format.read_back(win).collect()}
    assert got == brute_chat(far + same + large + null)
    by = defaultdict(list)
    for w in win.collect():
        by[w["conv_id"]].append((w["segment"], w["window"], chat_format.parsed(w["text"])))
    assert len(by[1]) < 60 and all(t[0] == ("system", "be brief") for _, _, t in by[1])
    assert len(by[3]) < 5 and sum(r == "system" for _, _, t in by[3] for r, _ in t) == 1  # over the budget: written once
    for parts in ("1", "9"):  # windows do not depend on the tasks
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = Counter((x["conv_id"], x["segment"], x["window"], x["text"]) for x in chat_format.windows(df, budget=200, history=60).collect())
        assert again == Counter((x["conv_id"], x["segment"], x["window"], x["text"]) for x in win.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# 7 ---------------------------------------------------------------- quality rules


def brute_counts(text):
    w = WORD.findall(text or "")
    t = list(zip(w, w[1:], w[2:]))
    n = Counter(t)
    hit = {i + k for i, x in enumerate(t) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "bé", " ", "\n", "c#", "|", "\x85", " ", "\t", "aa b c "]) for _ in range(r.randrange(40))) for _ in range(800)]
    for t in texts:
        words = t.encode().split()
        assert (len(words), *quality_rules.base_counts(t, words)) == brute_counts(t), repr(t)
    good = [(100 + i, prose(150, i), "en", "s", 0, 0.0, [], 0, "") for i in range(80)]
    junk = [(300, " ".join(f"{i:02d}#%$" for i in range(100)), "en", "s", 0, 0.0, [], 0, "")]
    docs = documents(spark, good + junk + awkward())
    out = quality_rules.judge(docs, quality_rules.references(docs))
    got = {x["doc_id"]: x for x in out.collect()}
    assert ids(out) == Counter([x[0] for x in good + junk]) + IDS
    assert all(got[x[0]]["kept"] for x in good) and not got[300]["kept"] and not got[300]["base_failed"]
    assert got[5]["base_failed"] and not got[6]["kept"] and got[5]["n_words"] == 0
    empty = documents(spark, [])
    assert quality_rules.references(empty) is None and quality_rules.judge(empty, None).count() == 0


def test_quality_verdicts_match_brute_force(spark):
    r, rows = random.Random(12), []
    for i in range(120):
        lang = ["en", "fr", None][i % 3]
        own = [f"{'le' if lang == 'fr' else 'the'}{r.randrange(60)}" if r.random() < 0.9 else f"Zz{r.randrange(10**6)}#|" for _ in range(r.choice([60, 90, 160]))]
        if i % 10 == 0:
            own = [f"Q{r.randrange(10**6)}%%" for _ in own]
        rows.append((i, " ".join(own), lang, "s", 0, 0.0, [], 0, ""))
    docs = documents(spark, rows)
    rules = quality_rules.Rules(most_class=0.3, most_word=0.5)
    got = {x["doc_id"]: x for x in quality_rules.judge(docs, quality_rules.references(docs, common=40), rules).collect()}

    def classes(raw):
        n = [0] * 8
        for c in raw:
            if not 0x80 <= c < 0xC0:
                ch = chr(c)
                k = 7 if c >= 0xC0 else 0 if ch in "abcdefghijklmnopqrstuvwxyz" else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in " \t\n\v\f\r" else 4 if ch in ".,;:!?'\"()-" else 5 if ch in "#*$%&|<>" else 6
                n[k] += 1
        return n

    def apart(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(2 * x / (x + z)) for x, z in zip(a, b) if x)
        return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))

    refs = {}
    for lang in ("en", "fr"):
        raw = [x[1].encode() for x in rows if x[2] == lang]
        words = Counter(w for t in raw for w in t.lower().split())
        top = sorted(words, key=lambda w: (-words[w], w))[:40]
        refs[lang] = ([sum(c) for c in zip(*map(classes, raw))], top, [words[w] for w in top] + [sum(words.values()) - sum(words[w] for w in top)])
    seen = Counter()
    for i, text, *_ in rows:
        raw, words = text.encode(), text.lower().encode().split()
        own = Counter(words)
        ok = False
        for c, top, q in refs.values():
            p = [own[w] for w in top]
            a = apart(classes(raw), c) if len(raw) >= 200 else 0
            b = apart(p + [len(words) - sum(p)], q) if len(words) >= 80 else 0
            ok |= a <= 0.3 and b <= 0.5
        assert got[i]["kept"] == (ok and not got[i]["base_failed"]), i
        seen[got[i]["kept"], len(words) >= 80] += 1
    assert min(seen[True, True], seen[False, True], seen[True, False]) > 0


def test_jensen_shannon_distance():
    p, q = np.array([1.0, 0, 3]), np.array([[1.0, 0, 3], [0, 5, 0]])
    assert quality_rules.distance(p, q) == pytest.approx([0, 1])


# 8 --------------------------------------------------------------------- sharding


def test_shards_match_the_mixture(spark):
    r = random.Random(8)
    rows = [(10_000 + i, "t" * r.randrange(50), None, "hot" if i < 700 else f"s{i % 7}" if i % 50 else f"only{i}", 0, 0.0, [], 0, "") for i in range(2000)] + awkward()
    out = sharding.stratified_shards(documents(spark, rows), 24, bucket_rows=100).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(x[0] for x in rows)
    by = defaultdict(list)
    for x in out:
        by[x["shard"]].append(x)
    assert set(by) == set(range(24))
    n = [len(b) for b in by.values()]
    assert max(n) - min(n) <= 1
    assert all(sorted(x["slot"] for x in b) == list(range(len(b))) for b in by.values())
    hot = [sum(x["source"] == "hot" for x in b) for b in by.values()]
    assert max(hot) - min(hot) <= 3
    size = {x[0]: (len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows}
    assert all((x["size"], x["text_crc32"]) == size[x["doc_id"]] for x in out if x["doc_id"] is not None)
    again = sharding.stratified_shards(documents(spark, rows[::-1]).repartition(3), 24, bucket_rows=100).collect()
    assert {(x["doc_id"], x["size"], x["shard"]) for x in again if IDS.get(x["doc_id"], 1) == 1} == {(x["doc_id"], x["size"], x["shard"]) for x in out if IDS.get(x["doc_id"], 1) == 1}
    assert sharding.stratified_shards(documents(spark, [])).count() == 0


def test_shards_of_rows_that_repeat(spark):
    """One row 900 times, over any bucket, among others: every copy has a place, and sources stay mixed."""
    rows = [(5, "same", None, "hot", 0, 0.0, [], 0, "")] * 900 + [(None, None, None, None, None, 0.0, [], 0, "")] * 150 + [(5, f"other {k}", None, "hot", 0, 0.0, [], 0, "") for k in range(150)]
    out = sharding.stratified_shards(documents(spark, rows), 24, bucket_rows=50).collect()
    by = defaultdict(list)
    for x in out:
        by[x["shard"]].append(x)
    assert len(out) == 1200 and {len(b) for b in by.values()} == {50} and all(sorted(x["slot"] for x in b) == list(range(50)) for b in by.values())
    assert Counter((x["doc_id"], x["size"]) for x in out)[5, 12] == 900
    hot = [sum(x["source"] == "hot" for x in b) for b in by.values()]
    assert max(hot) - min(hot) <= 2


def test_shards_match_brute_force(spark):
    r = random.Random(18)
    rows = [(i, "x" * r.randrange(30), None, f"s{r.randrange(4)}" if i % 9 else None, 0, 0.0, [], 0, "") for i in range(500)]
    got = {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.stratified_shards(documents(spark, rows), 24, seed=7, bucket_rows=40).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = defaultdict(list)
    for i, text, source in ((x[0], x[1], x[3]) for x in rows):
        by["\0" if source is None else source].append((md5(f"7:{i}:{zlib.crc32(text.encode())}:{len(text) + 8}"), i))
    line = []
    for source, own in by.items():
        start = int(md5(f"7/{source}")[:7], 16) / 16**7
        line += [((k + start) / len(own), source, h, i) for k, (h, i) in enumerate(sorted(own))]
    want, n = {}, len(rows)
    for rank, (*_, i) in enumerate(sorted(line)):
        shard = rank * 24 // n
        want[i] = (shard, rank - (shard * n + 23) // 24)
    assert got == want


# 9 -------------------------------------------------------------- near duplicates


def brute_classes(rows, least=0.8):
    hashes = WordHashes()
    texts = sorted({r[1] for r in rows if r[1] is not None})
    bags = [near_duplicates.shingles(t, hashes) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i][0]) and len(bags[j][0]) and near_duplicates.similarity(bags[i], bags[j]) >= least:
                parent[root(i)] = root(j)
    group = {t: root(i) for i, t in enumerate(texts)}
    first = {}
    for r in rows:
        if r[1] is not None:
            own = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
            first[group[r[1]]] = min(first.get(group[r[1]], own), own)
    name = lambda i: "null" if i is None else str(i)
    named = {g: f"{'null' if no else i}:{key}" for g, (no, i, key) in first.items()}
    return Counter((r[0], f"{name(r[0])}:" if r[1] is None else named[group[r[1]]]) for r in rows)


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(9)
    rows, k = awkward(), 1000
    rows += [(2, "one id with another text that is no copy", *rows[0][2:]), (None, prose(70, 3) + " more", *rows[0][2:])]
    for f in range(25):
        base = prose(r.randrange(30, 300), 100 + f).split(" ")
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 40)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(t), None, None, 0, 0.0, [], 0, ""))
            k += 1
    out = near_duplicates.near_duplicates(documents(spark, rows))
    got = out.collect()
    assert Counter((x["doc_id"], x["class_id"]) for x in got) == brute_classes(rows)
    size = Counter(c for _, c in {(x["key"], x["class_id"]) for x in got if x["key"]})  # texts of each class
    assert all((x["links"] > 0) == (x["similarity"] is not None) == (size[x["class_id"]] > 1) and (x["similarity"] or 1) >= 0.8 for x in got)
    assert all(x["class_doc"] == (None if x["class_id"].startswith("null") else int(x["class_id"].split(":")[0])) for x in got)
    assert near_duplicates.near_duplicates(documents(spark, [])).count() == 0


def test_bagminhash_is_unbiased():
    r, hashes, errors = random.Random(3), WordHashes(), []
    for n, edits in ((30, 1), (100, 3), (300, 9), (60, 8)):
        for k in range(12):
            a = prose(n, 7 * k + n).split(" ")
            b = list(a)
            for _ in range(edits):
                b[r.randrange(n)] = f"z{r.randrange(10**6)}"
            if k % 2:
                a, b = a + a[: n // 2], b + b[: n // 2]
            x, y = near_duplicates.shingles(" ".join(a), hashes), near_duplicates.shingles(" ".join(b), hashes)
            h = near_duplicates.signatures([x, y])
            errors.append(float((h[0] == h[1]).mean()) - near_duplicates.similarity(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (103, 100)]
    got = {x["node"]: x["least"] for x in near_duplicates.components(spark.createDataFrame(links, "node long, centre long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in (101, 102, 103))


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A family on one template at 0.78, with pairs of it at 0.82, in buckets of several stretches."""
    monkeypatch.setattr(near_duplicates, "TILE_ROWS", 64)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 16)
    r = random.Random(9)
    template = [f"t{i}" for i in range(92)]  # 88 shingles
    fresh = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for k in range(300):
        texts.append(template + fresh(12) if k % 10 else template + (own := fresh(2)) + fresh(10))
        if k % 10 == 0:
            texts.append(template + own + fresh(10))
    assert near_duplicates.TILE_ROWS < len(texts)
    rows = [(i, " ".join(w), None, None, 0, 0.0, [], 0, "") for i, w in enumerate(texts)]
    bags = [near_duplicates.shingles(x[1], WordHashes()) for x in rows]
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_duplicates.similarity(bags[a], bags[b]) >= 0.8:
                least[a] = least[b]
                break
    assert len(rows) - len(set(least)) == 30
    got = {x["doc_id"]: x["class_doc"] for x in near_duplicates.near_duplicates(documents(spark, rows)).collect()}
    assert got == dict(enumerate(least))


def test_near_duplicates_of_a_family_match_independent_brute_force(spark):
    """160 copies of one text, each with up to five words changed, by plain Python multisets of word tuples."""
    r = random.Random(11)
    base, texts = prose(200, 31).split(" "), []
    for k in range(160):
        t = list(base)
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**9)}"
        texts.append(" ".join(t))
    bags = [Counter(zip(*(t.lower().split()[i:] for i in range(5)))) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = (bags[a] & bags[b]).total()
            if both / (bags[a].total() + bags[b].total() - both) >= 0.8 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    rows = [(i, t, None, None, 0, 0.0, [], 0, "") for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["class_doc"] for x in near_duplicates.near_duplicates(documents(spark, rows)).collect()}
    assert 1 < len(set(group)) < 120 and got == {i: least[g] for i, g in enumerate(group)}


def test_rows_of_a_template_s_tiles_grow_with_its_documents(spark, monkeypatch):
    """300 words of which six are changed at random places: most pairs are below 0.8, and all meet in some bucket."""
    rows, whole = {}, near_duplicates.written

    def counted(df, name):
        out = whole(df, name)
        if name == "neardup_tiles":
            rows[n] = out.agg(F.sum("rows")).first()[0]
        return out

    monkeypatch.setattr(near_duplicates, "written", counted)
    for n in (300, 600):
        r = random.Random(3)
        texts = []
        for _ in range(n):
            t = [f"t{i}" for i in range(300)]
            for _ in range(6):
                t[r.randrange(300)] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(t))
        bags = [near_duplicates.shingles(t, WordHashes()) for t in texts]
        both = near_duplicates.overlaps(bags, np.arange(n), np.arange(n))
        size = np.array([c.sum() for _, c in bags])
        group = list(range(n))
        for a, b in zip(*np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size[None, :] - both), 1)), strict=True):
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        docs = documents(spark, [(i, t, None, None, 0, 0.0, [], 0, "") for i, t in enumerate(texts)])
        assert {x["doc_id"]: x["class_doc"] for x in near_duplicates.near_duplicates(docs).collect()} == dict(enumerate(group))
    assert rows[600] <= 2.2 * rows[300]


def test_pairs_just_above_the_threshold_are_found(spark):
    """1,500 pairs of 0.80 to 0.85: the stated chance to lose one is 6e-6."""
    r = random.Random(12)
    texts = []
    while len(texts) < 3000:
        a = [f"p{r.randrange(10**9)}" for _ in range(r.randrange(60, 160))]
        b = list(a)
        while (s := near_duplicates.similarity(*(near_duplicates.shingles(" ".join(x), WordHashes()) for x in (a, b)))) > 0.85:
            b[r.randrange(len(b))] = f"q{r.randrange(10**9)}"
        if s >= 0.8:
            texts += [" ".join(a), " ".join(b)]
    docs = documents(spark, [(i, t, None, None, 0, 0.0, [], 0, "") for i, t in enumerate(texts)])
    got = {x["doc_id"]: x["class_doc"] for x in near_duplicates.near_duplicates(docs).collect()}
    assert sum(got[i + 1] == i for i in range(0, len(texts), 2)) == 1500


# 10 -------------------------------------------------------------- decontamination


def brute_hits(docs, items, width=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            q = split(t)
            for i in range(max(1, len(q) - width + 1) if q else 0):
                win = q[i : i + width]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str("" if item is None else item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination_matches_brute_force(spark):
    r = random.Random(10)
    items = [(i, prose(r.randrange(14, 40), 500 + i, 50)) for i in range(12)] + [(12, "one two three"), (12, "Solo"), (13, ""), (14, None), (None, "w1x w2x"), (15, "no such words at all")]
    rows = awkward()
    for k in range(60):
        w = prose(100, 900 + k, 50).split(" ")
        for _ in range(r.randrange(3)):
            q = (r.choice(items)[1] or "").split(" ")
            a = r.randrange(len(q))
            at = r.randrange(len(w))
            w[at:at] = [x.upper() for x in q[a : a + r.randrange(10, 30)]]
        rows.append((2000 + k, " ".join(w) + (", solo" if k % 9 == 0 else ""), None, None, 0, 0.0, [], 0, ""))
    bench = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, key string")
    out = decontamination.decontaminate(documents(spark, rows), bench).collect()
    got = Counter((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in out)
    assert got == brute_hits([(x[0], x[1]) for x in rows], items)
    assert all((x["n_phrases"] > 0) == (x["n_hit"] > 0) for x in out)
    least = decontamination.decontaminate(documents(spark, [(-(2**63), "one two three", *rows[0][2:]), (None, "one two three", *rows[0][2:])]), bench).collect()
    assert {x["doc_id"] for x in least} == {-(2**63), None} and all(x["n_hit"] == 3 for x in least)
    none = decontamination.decontaminate(documents(spark), bench.limit(0)).collect()
    assert len(none) == len(awkward()) and not any(x["contaminated"] for x in none)
    assert decontamination.decontaminate(documents(spark, []), bench).count() == 0


def test_proximity_matches(spark):
    """The two rarest words of a window, one word out of place: no phrase, but a near match; too far apart: neither."""
    item = " ".join(f"k{i}" for i in range(13))
    words = item.split()
    near, far = words[:7] + ["more"] + words[7:], words[:7] + ["x"] * 9 + words[7:]
    rows = [(i, " ".join(w), None, None, 0, 0.0, [], 0, "") for i, w in enumerate((words, near, far, words[1:12] * 3))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x["doc_id"]: x for x in decontamination.decontaminate(documents(spark, rows), bench).collect()}
    assert got[0]["n_phrases"] == 1 and got[0]["n_near"] == 0 and got[0]["contaminated"]
    assert got[1]["n_phrases"] == 0 and got[1]["n_near"] == 1 and not got[1]["contaminated"]
    assert got[2]["n_phrases"] == 0 and got[2]["n_near"] == 0


def test_big_ids_stay_exact(spark):
    for out in (secrets.scan(documents(spark)), packing.pack(documents(spark)), near_duplicates.near_duplicates(documents(spark)), lm_scoring.score(documents(spark), F.lit(True))):
        assert BIG in {x["doc_id"] for x in out.collect()}
