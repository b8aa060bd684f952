"""Near-duplicate groups by BagMinHash.

A text is the multiset of its shingles (five lower-cased words; a shorter text is one shingle). BagMinHash
signs it so that each of m components of two signatures agrees with the probability of their weighted Jaccard
similarity: every shingle has Poisson processes over its weight axis, cut at the powers of two, with points
that carry a time, a component and a weight level; levels over the shingle's count are thinned away, and a
component keeps the least time. A process ends when its time passes the largest of the minima, so a text
costs about one point a shingle and m log m more.

Signatures are cut into bands; texts that share a band meet in a bucket. Equal texts are one node, found by their
digest, whatever their number. Groups are the connected components of verified links, found in two steps:

1. Stars, in the first `STAR_BANDS` bands. A bucket's members are linked to its centre: the member that meets most
   others in all bands, which in a family of copies is the text that the others came from. Links are verified on the
   exact multisets of the whole texts. After this a family is nearly one component, and most buckets hold one only.
2. Rests. In every bucket that still holds several components, of whatever size, all its members of different
   components are compared, tile by tile: a tile is two stretches of the members, of bounded number and
   bytes, and tiles of one component are left out. A byte of each component of the signatures estimates the similarity;
   pairs estimated at `least` - `MARGIN` or more, each in the first bucket it shares, are verified on their texts.

So a link is lost only where a pair shares no band, which at similarity 0.8 has the probability
(1 - 0.8**rows)**bands, 5e-6, or where the estimate is off by more than the margin, 7e-7. A stretch holds thousands of
members, so the rows of step 2 grow with the members; beyond a stretch each goes to one more tile for each further stretch.
Within a tile members are compared in the square of their number, by 240 bytes each, and texts only where these agree.

Centres with many links are salted. All tables that a later step reads are written to the shared folder; nothing
is collected.

Defined results: a class is named by its least id and the digest of the text that has it (`class_id`, as text;
ids that repeat with other texts keep their classes apart). Null ids come last and are written `null`; a null
text is a class of its id; empty texts are equal texts, and so one class; repeated rows are copies; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordHashes, mixed, removed, sliced, written

WIDTH = 5
BANDS, ROWS = 40, 6
GOLD = 0x9E3779B97F4A7C15
STAR_BANDS = 5
MARGIN = 0.125
TILE_ROWS, TILE_BYTES = 2048, 12_000_000
BLOCK_ROWS = 256
TILE_COLUMNS = 4096
PART_ROWS = 2_000  # members in a task's part of small tiles, about
SALT_ROWS = 400
BROADCAST_ROWS = 100_000


def shingles(text: str, hashes: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    w = hashes.of(text.lower().encode("utf-8", "replace").split())
    if not len(w):
        return w, w.astype(np.int64)
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = mixed(h * np.uint64(0x100000001B3) + w[i : i + n])
    return np.unique(h, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 1.0


def _golden(k: int) -> np.uint64:
    return np.uint64(k * GOLD & 0xFFFFFFFFFFFFFFFF)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of each multiset: len(bags) x m times of Poisson processes; infinite for an empty bag."""
    h = np.full(len(bags) * m, np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    if not len(doc):
        return h.reshape(-1, m)
    x, w = np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags])
    # The weight axis [0, w) in pieces [0, 1), [1, 2), [2, 4), ...: one process for each piece that it reaches.
    parts = []
    low, size, piece = 0, 1, 0
    at = np.arange(len(doc))
    while len(at := at[w[at] > low]):
        parts.append((doc[at], mixed(x[at] + _golden(piece)), w[at], np.full(len(at), low), np.full(len(at), size)))
        low, size, piece = low + size, max(1, low + size), piece + 1
    doc, seed, w, low, size = (np.concatenate(p) for p in zip(*parts, strict=True))
    t = np.zeros(len(doc))
    step = 0
    while len(doc):
        u = mixed(seed + _golden(2 * step + 1))
        t = t - np.log(_uniform(u)) / size
        live = t < h.reshape(-1, m).max(1)[doc]
        if not live.all():
            doc, seed, w, low, size, t = doc[live], seed[live], w[live], low[live], size[live], t[live]
        v = mixed(seed + _golden(2 * step + 2))
        inside = low + (v >> np.uint64(32)).astype(np.int64) % size < w  # the point's level is one the text has
        component = (v & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        np.minimum.at(h, doc[inside] * m + component[inside], t[inside])
        step += 1
    return h.reshape(-1, m)


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = h.view(np.uint64).reshape(len(h), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLD), (len(h), bands))
    for r in range(rows):
        key = mixed(key ^ bits[:, :, r])
    return key.view(np.int64)


def sketched(h: np.ndarray) -> np.ndarray:
    """A byte of each component of each signature."""
    return (mixed(h.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), size in bytes, band keys and sketch of every row with a text."""

    schema = "doc_id long, key string, size int, bands array<long>, sketch binary"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for x in sliced(batches, 256):
            keys = x.column("key").to_pylist()
            first = {k: i for i, k in reversed(list(enumerate(keys)))}
            h = signatures(bags := [shingles(x.column("text")[i].as_py(), hashes) for i in first.values()])
            of = {k: (row, s.tobytes()) if len(b[0]) else ([], b"") for k, row, s, b in zip(first, band_keys(h), sketched(h), bags, strict=True)}
            columns = [x.column("doc_id"), x.column("key"), x.column("size"), [of[k][0] for k in keys], [of[k][1] for k in keys]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"), F.octet_length("text").alias("size"), "text")
    return rows.mapInArrow(run, schema)


def _texts(shared: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the nodes that share a bucket: only theirs are shuffled, and only once."""
    wanted = shared.join(nodes.select("node", "key"), "node")
    few = shared.count() <= BROADCAST_ROWS  # rows of a digest and an id: 10 MB at most
    rows = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    held = rows.join(F.broadcast(wanted) if few else wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    return written(held, "neardup_texts")


def _verified(links: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links (node, centre) of a written table whose whole texts have a similarity of at least `least`, with it."""
    heavy = links.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS).select("centre", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    few = links.count() // SALT_ROWS <= BROADCAST_ROWS  # heavy centres are no more than that; the others have no salt
    salted = links.join(F.broadcast(heavy) if few else heavy, "centre", "left")
    members = salted.select("node", "centre", F.expr("pmod(xxhash64(node), coalesce(salts, 1))").cast("int").alias("salt"), F.lit(1).alias("member"))
    centres = members.select(F.col("centre").alias("node"), "centre", "salt", F.lit(0).alias("member")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, at, bag = WordHashes(), None, None
        for x in batches:
            found = []
            for node, centre, member, text in zip(x["node"], x["centre"], x["member"], x["text"], strict=True):
                own = shingles(text, hashes)
                if not member:
                    at, bag = centre, own
                elif at == centre and (s := similarity(own, bag)) >= least:
                    found.append((node, centre, s))
            yield pd.DataFrame(found, columns=["node", "centre", "similarity"])

    parts = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    paired = members.unionByName(centres).join(texts, "node").repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", "member", "node")
    return paired.select("node", "centre", "member", "text").mapInPandas(run, "node long, centre long, similarity double")


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """rows x columns: the size of the common multiset of each two bags."""
    own = np.unique(np.concatenate([rows, columns]))
    bags, rows, columns = [bags[i] for i in own], np.searchsorted(own, rows), np.searchsorted(own, columns)
    n = np.array([len(x) for x, _ in bags])
    of, x, c = np.repeat(np.arange(len(bags)), n), np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags])
    # A shingle's k-th occurrence is an element of its own: then common elements are counted.
    of, x = np.repeat(of, c), np.repeat(x, c)
    kth = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
    _, column, shared = np.unique(mixed(x + mixed(kth.astype(np.uint64))), return_inverse=True, return_counts=True)
    place = np.cumsum(shared > 1) - 1
    of, column = of[shared[column] > 1], place[column[shared[column] > 1]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(rows), len(columns)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_COLUMNS):
        a, b = np.searchsorted(column, [at, at + TILE_COLUMNS])
        has = np.zeros((len(bags), TILE_COLUMNS), np.float32)
        has[of[a:b], column[a:b] - at] = 1
        both += has[rows] @ has[columns].T
    return both


def likely(bucket: int, side: np.ndarray, label: np.ndarray, sketch: np.ndarray, bands: np.ndarray, least: float) -> np.ndarray:
    """Which members of a tile have a partner of another component that the sketches put at `least` - MARGIN or more, and that meets them in no band before this bucket's."""
    rows = np.nonzero(side == 0)[0]
    columns = np.nonzero(side == 1)[0] if side.any() else rows
    some = np.zeros(len(side), bool)
    enough = (least - MARGIN) * sketch.shape[1]
    for r in rows:
        near = columns[((sketch[columns] == sketch[r]).sum(1) >= enough) & (label[columns] != label[r])]
        if len(near):
            met = bands[near] == bands[r]
            near = near[bands[near, met.argmax(1)] == bucket]
            some[near] = True
            some[r] |= len(near) > 0
    return some


def _rests(here: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The verified links (node, centre, similarity) between all members of different components in the buckets of here(bucket, node, label, size)."""
    facts = nodes.select("node", "bands", "sketch")
    # A component's members fill stretches of their own where they are many, and share stretches with those of others where they are few.
    share = F.greatest(F.col("size") / TILE_BYTES, F.lit(1.0 / TILE_ROWS))
    held = here.withColumn("share", share)
    own = held.groupBy("bucket", "label").agg(F.sum("share").alias("own"))
    few = own.where("own < 1").groupBy("bucket").agg(F.sum("own").alias("few"))
    own = own.join(few, "bucket", "left").select("bucket", "label", F.when(F.col("own") >= 1, F.ceil("own")).alias("own"), F.ceil("few").alias("few"))
    alone = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("own")))
    stretch = F.when(F.col("own").isNotNull(), alone).otherwise(F.pmod(F.xxhash64("label"), F.col("few")))
    cut = written(held.join(own, ["bucket", "label"]).select("bucket", "node", "label", stretch.alias("stretch")), "neardup_stretches")
    ends = cut.groupBy("bucket", "stretch").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    left = ends.select("bucket", F.col("stretch").alias("i"), F.col("low").alias("a"), F.col("high").alias("b"), F.col("n").alias("p"))
    right = ends.select("bucket", F.col("stretch").alias("j"), F.col("low").alias("c"), F.col("high").alias("d"), F.col("n").alias("q"))
    tiles = written(left.join(right, "bucket").where("i <= j and least(a, c) < greatest(b, d)").select("bucket", "i", "j", F.expr("p + if(i < j, q, 0)").alias("rows")), "neardup_tiles")
    parts = max(1, (tiles.agg(F.sum("rows")).first()[0] or 0) // PART_ROWS)
    one = tiles.join(cut.withColumnRenamed("stretch", "i"), ["bucket", "i"]).select("bucket", "i", "j", "node", "label", F.lit(0).alias("side"))
    two = tiles.where("i < j").join(cut.withColumnRenamed("stretch", "j"), ["bucket", "j"]).select("bucket", "i", "j", "node", "label", F.lit(1).alias("side"))
    members = one.unionByName(two).join(facts, "node").withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts)))

    def estimated(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["bucket", "i", "j"], kind="stable")
        bucket, i, j, side, label = (x[c].to_numpy() for c in ("bucket", "i", "j", "side", "label"))
        sketch, bands = np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(len(x), -1), np.stack(list(x["bands"]))
        starts = np.nonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[0]
        some = np.zeros(len(x), bool)
        for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
            some[a:b] = likely(bucket[a], side[a:b], label[a:b], sketch[a:b], bands[a:b], least)
        return x.loc[some, ["bucket", "i", "j", "node", "label", "side"]]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        bags = [shingles(t, hashes) for t in x["text"]]
        side, label, node = x["side"].to_numpy(), x["label"].to_numpy(), x["node"].to_numpy()
        rows = np.nonzero(side == 0)[0]
        columns = np.nonzero(side == 1)[0] if side.any() else rows
        size = np.array([int(c.sum()) for _, c in bags], float)
        pairs = []
        for a in range(0, len(rows), BLOCK_ROWS):  # the tile block by block, so that its matrices stay small
            for b in range(0 if side.any() else a, len(columns), BLOCK_ROWS):
                own, others = rows[a : a + BLOCK_ROWS], columns[b : b + BLOCK_ROWS]
                both = overlaps(bags, own, others)
                every = size[own][:, None] + size[others][None, :] - both
                r, c = np.nonzero((both >= least * every * (1 - 1e-9)) & (label[own][:, None] != label[others][None, :]))
                pairs += [(node[i], node[j], s) for i, j in zip(own[r], others[c], strict=True) if (side.any() or i < j) and (s := similarity(bags[i], bags[j])) >= least]
        return pd.DataFrame(pairs, columns=["node", "centre", "similarity"])

    close = members.groupBy("part").applyInPandas(estimated, "bucket long, i long, j long, node long, label long, side int")
    close = written(close, "neardup_close")
    pairs = close.join(texts, "node").groupBy("bucket", "i", "j").applyInPandas(run, "node long, centre long, similarity double")
    pairs = written(pairs, "neardup_rest_links")
    removed(cut, tiles, close)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """node, least: the least node of each connected component of links(node, centre). Large-star and small-star steps, written each time: plans stay small."""
    edges = links.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).where("a != b").distinct()
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: each node's smaller neighbours, and the node itself, point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        of = edges
        edges = written(large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "neardup_edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if before:
            removed(of)
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), "least")
        before = now


def _linked(nodes: DataFrame, docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """node, label (the least node of its component) of the nodes that share a bucket; and the verified links."""
    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = written(rows.join(shared, "bucket"), "neardup_met")
    # A node's rank: how many others it meets. The text that a family was copied from meets the most of it.
    rank = written(met.groupBy("node").agg(F.sum("members").alias("rank")), "neardup_rank")
    texts = _texts(rank.select("node"), nodes, docs)
    stars = met.where(F.col("band") < STAR_BANDS).join(rank, "node")
    centres = stars.groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    links = written(stars.join(centres, "bucket").where("node != centre").select("node", "centre").distinct(), "neardup_links")
    found = written(_verified(links, texts, least), "neardup_verified")
    labels = written(rank.select("node").join(components(found), "node", "left").select("node", F.coalesce("least", "node").alias("label")), "neardup_labels")
    here = met.select("node", "size", "bucket").join(labels, "node")
    mixed_up = here.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    here = written(here.join(mixed_up, "bucket"), "neardup_rests")  # a bucket of one component is done with
    rest = _rests(here, nodes, texts, least)
    removed(met, links, texts, here)
    side = labels.select(F.col("node").alias("centre"), F.col("label").alias("other"))
    merged = components(rest.join(labels, "node").join(side, "centre").select(F.col("label").alias("node"), F.col("other").alias("centre")))
    ends = labels.join(merged.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return ends, found.unionByName(rest)


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """A row for each of docs: doc_id, class_id, class_doc (the id that names the class), copies (rows with the same text), links (verified with other texts), similarity (of the closest of them) and key (digest of the text)."""
    signed = written(_signed(docs), "neardup_signed")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("size", "bands", "sketch")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup_nodes")  # written once, so the ids hold
    labels, links = _linked(nodes, docs, least)
    of = nodes.select("node", "key", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = of.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "key")).alias("first"))
    classes = of.join(names, "label").select("node", "key", "copies", F.col("first.rep").alias("class_doc"), F.concat_ws(":", F.coalesce(F.col("first.rep").cast("string"), F.lit("null")), "first.key").alias("class_id"))
    ends = links.select("node", "similarity").unionByName(links.select(F.col("centre").alias("node"), "similarity"))
    own = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.max("similarity").alias("similarity"))
    classes = classes.join(own, "node", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    none = F.lit(None).cast("double")
    columns = ["doc_id", "class_id", "class_doc", "copies", "links", "similarity", "key"]
    named = signed.select("doc_id", "key").join(classes, "key").select(columns)
    own_id = F.col("doc_id").cast("long")
    null = docs.where("text is null").select(own_id.alias("doc_id"), F.concat(F.coalesce(own_id.cast("string"), F.lit("null")), F.lit(":")).alias("class_id"), own_id.alias("class_doc"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), none.alias("similarity"), F.lit(None).cast("string").alias("key"))
    return named.unionByName(null)
