"""Every stage of the pipeline against a brute-force version of its decision, over awkward rows."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from tests.llm.data import awkward, documents, prose
from tests.llm.test_operators import brute_classes, brute_hits, toxic_rows


def folder(spark, tmp_path, rows, labels, items):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    toxic, labels = toxic_rows(300, 2)
    secret = [(5000, prose(60, 77) + " token=0123456789abcdef0123", None, None, 0, 0.0, [], 0, "")]
    items = [(1, prose(30, 4242))]
    dirty = [(6000, prose(20, 5) + " " + items[0][1], None, None, 0, 0.0, [], 0, "")]
    rows = [(9000 + x[0], *x[1:]) for x in toxic] + awkward() + secret + dirty
    sf = folder(spark, tmp_path, rows, [(9000 + a, b, c) for a, b, c in labels], items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.drop_toxic(spark, docs, sf).collect()
    bad = {9000 + x[0] for x in labels if x[2]}
    assert kept[0].__fields__ == P.COLUMNS
    assert Counter(x["doc_id"] for x in kept) == Counter(x[0] for x in rows if x[0] not in bad)
    classes = brute_classes([(x["doc_id"], x["text"]) for x in kept])
    nulls = Counter(x["doc_id"] for x in kept if x["text"] is None)
    unique = P.drop_near_duplicates(spark, spark.createDataFrame(kept, docs.select(P.COLUMNS).schema), sf).collect()
    named = Counter({c for _, c in classes if not c.endswith(":")})
    digest = lambda x: f"{'null' if x['doc_id'] is None else x['doc_id']}:{hashlib.md5(x['text'].encode()).hexdigest()}"
    assert Counter(digest(x) for x in unique if x["text"] is not None) == named
    assert Counter(x["doc_id"] for x in unique if x["text"] is None) == nulls
    clean = P.drop_contaminated(spark, spark.createDataFrame(unique, docs.select(P.COLUMNS).schema), sf).collect()
    hits = {k[0] for k in brute_hits([(x["doc_id"], x["text"]) for x in unique], items) if k[5]}
    assert 6000 in hits and Counter(x["doc_id"] for x in clean) == Counter(x["doc_id"] for x in unique if x["doc_id"] not in hits)
    red = P.redact_secrets(spark, spark.createDataFrame(clean, docs.select(P.COLUMNS).schema), sf).collect()
    assert len(red) == len(clean) and [x for x in red if x["doc_id"] == 5000][0]["text"].endswith("[SECRET]")
    pieces = P.run(spark, sf)
    assert {x["doc_id"] for x in pieces.collect()} == {x["doc_id"] for x in red}
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_an_id_that_repeats_with_other_texts_loses_no_class(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(5, a), (5, b), (3, b), (7, a), (7, c), (7, c), (None, c), (None, a), (None, None), (None, None)]
    docs = documents(spark, [(i, t, None, None, 0, 0.0, [], 0, "") for i, t in rows])
    got = Counter((x["doc_id"], x["text"]) for x in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(5, a), (3, b), (7, c), (None, None), (None, None)])
