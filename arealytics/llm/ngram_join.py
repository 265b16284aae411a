"""N-gram Jaccard self-join of documents by MinHash banding: classes of near duplicates and every document's links.

1. Texts become sets of hashed word 5-grams. Texts with the same set are one text with copies; from here on only one row per set is used.
2. MinHash signatures are cut into bands; band and row counts are the most selective ones that find a pair at the threshold with the
   target recall. Rows are shuffled on band hashes; buckets with one member vanish, the others tie their members to the smallest one.
   The components of these ties are the candidate groups: each text is in one of them, so its set is shuffled once.
3. Large groups are cut into blocks of bounded size. Every two blocks of a group are compared in one task, which verifies its pairs on the
   full sets and returns only counts of links and a spanning forest of them: no pair is ever a row.
4. Classes are the components of the forests' edges.

Defined results: a NULL text counts as empty; texts without words are copies only of the same text and link to nothing else; texts
of fewer than five words have one n-gram of all their words; repeated rows are copies; links count documents (copies included),
text_links count different sets; the class is the smallest id in it, and rows without an id count after all others (a class of such rows
alone has a NULL class). An empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, released, row_key, written

WORDS = re.compile(r"\w+")
PRIME = (1 << 61) - 1
BLOCK_TEXTS, BLOCK_GRAMS, COLUMNS, PART_ROWS, KEPT_WORDS = 256, 200_000, 8_192, 500, 60_000
_WORD: dict[str, int] = {}


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes whose chance to miss a pair at the threshold is 1 - recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        chance = threshold ** rows  # that a band of a pair at the threshold agrees
        bands = 1 if chance == 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def small_batches(batches):
    """Batches of few rows; the words remembered for hashing stay bounded and go with the task."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                if len(_WORD) > KEPT_WORDS:
                    _WORD.clear()
                yield batch.slice(at, PART_ROWS)
    finally:
        _WORD.clear()


def grams(text: str, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words).difference(_WORD):
        _WORD[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))
    size = max(1, len(h) - n + 1)
    out = np.full(size, len(h) if len(h) < n else n, np.uint64)
    for i in range(min(n, len(h))):
        out = (out ^ h[i:i + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 2 ** 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2 ** 63, count, dtype=np.uint64)


def band_hashes(own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature."""
    a, b = _multipliers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 2048):
        mixed = own[at:at + 2048, None] * a[None, :] + b[None, :]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    out = np.arange(bands, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        out = (out ^ part) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def signatures(documents: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, key, bands): key is equal for texts of the same n-gram set; bands is NULL where there are no words."""
    def made(batches):
        for batch in small_batches(batches):
            keys, found = [], []
            for t in batch.column("text").to_pylist():
                own = grams(t, n)
                keys.append(xxhash.xxh128_digest(own.tobytes() if len(own) else b"text" + t.encode("utf-8", "surrogatepass")))
                found.append(band_hashes(own, bands, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["row", "doc_id", "key", "bands"])

    read = documents.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return read.mapInArrow(released(made), "row long, doc_id long, key binary, bands array<long>")


def bucket_edges(texts: DataFrame) -> DataFrame:
    """(key, other): every member of a bucket of two or more texts with the bucket's smallest key."""
    flat = written(texts.select("key", F.posexplode("bands").alias("band", "hash")).select("key", F.xxhash64("band", "hash").alias("bucket")))
    lead = flat.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("other")).where("n > 1").select("bucket", "other")
    return flat.join(lead, "bucket").where("key <> other").select("key", "other").distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of incidence matrices over the n-grams on both sides, some columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    out = np.zeros((len(left), len(right)), np.float32)
    place_a, place_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (place_a < len(common)) & (common[np.minimum(place_a, max(len(common) - 1, 0))] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (place_b < len(common)) & (common[np.minimum(place_b, max(len(common) - 1, 0))] == b) if len(common) else np.zeros(len(b), bool)
    row_a, place_a, row_b, place_b = row_a[in_a], place_a[in_a], row_b[in_b], place_b[in_b]
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        pick = (place_a >= at) & (place_a < at + width)
        x[row_a[pick], place_a[pick] - at] = 1
        pick = (place_b >= at) & (place_b < at + width)
        y[row_b[pick], place_b[pick] - at] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between numbered texts."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(near)):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(left[i]), int(right[j])))
    return edges


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """(key, other, links, text_links) of the table (group, key, copies, grams): counts (other NULL) and forest edges."""
    size = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = members.join(size, "group").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # Block b meets every block c: once as the lower and once as the higher of the pair.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least(c, F.col("block")).alias("low"), F.greatest(c, F.col("block")).alias("high")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("group", "pair.low", "pair.high", "block", "key", "copies", "grams")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        low, high = frame["low"].iat[0], frame["high"].iat[0]
        sides = [frame[frame["block"] == side].reset_index(drop=True) for side in (low, high)]
        empty = pd.DataFrame({"key": pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "links": pd.Series([], dtype="int64"), "text_links": pd.Series([], dtype="int64")})
        if not len(sides[0]) or not len(sides[1]):
            return empty
        sets = [[np.asarray(g, np.int64).view(np.uint64) for g in side["grams"]] for side in sides]
        sets = [[np.sort(g) for g in s] for s in sets]
        shared = _shared(*sets)
        sizes = [np.array([len(g) for g in s]) for s in sets]
        near = shared >= threshold * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9
        if low == high:
            near = np.triu(near, 1)
        copies = [side["copies"].to_numpy() for side in sides]
        offset = 0 if low == high else len(sides[0])
        numbers = [np.arange(len(sides[0])), np.arange(len(sides[1])) + offset]
        keys = list(sides[0]["key"]) + ([] if low == high else list(sides[1]["key"]))
        links, texts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(links, numbers[0], near @ copies[1])
        np.add.at(links, numbers[1], near.T @ copies[0])
        np.add.at(texts, numbers[0], near.sum(1))
        np.add.at(texts, numbers[1], near.sum(0))
        some = np.flatnonzero(texts)
        counted = pd.DataFrame({"key": [keys[i] for i in some], "other": None, "links": links[some], "text_links": texts[some]})
        edges = _forest(near, *numbers)
        linked = pd.DataFrame({"key": [keys[a] for a, _ in edges], "other": [keys[b] for _, b in edges], "links": 0, "text_links": 0})
        out = pd.concat([x for x in (counted, linked) if len(x)] or [empty], ignore_index=True)
        if len(frame) > BLOCK_TEXTS // 2:
            del frame, sides, sets, shared, near
            give_back()
        return out

    return dealt.groupBy("group", "low", "high").applyInPandas(compare, "key binary, other binary, links long, text_links long")


def ends(edges: DataFrame) -> DataFrame:
    return written(edges.select(F.explode(F.array("key", "other")).alias("key")).distinct())


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each vertex's component. Rounds of large and small stars (all larger neighbours, then all smaller
    ones, are tied to the smallest) until nothing moves; every round is a written table."""
    links = written(edges.select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        links = written(large.join(least, "a").select(tied.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    tied = links.groupBy("a").agg(F.min("b").alias("root"))
    return vertices.join(tied, F.col("key") == F.col("a"), "left").select("key", F.coalesce("root", "key").alias("label"))


def memberships(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(row, doc_id, class_id, class_row, links, text_links, copies): one row per document. row is row_key(doc_id, text), class_row that of
    the class's first document: smallest id, then smallest row."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(documents, doc_id, text, n, bands, rows))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    texts = written(signed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")))
    ties = written(bucket_edges(texts.where("bands IS NOT NULL")))
    met = components(ties, ends(ties)).withColumnRenamed("label", "group")
    # The sets of the texts that meet others are read again, from one document each; all other texts stay where they are.
    asked = written(met.join(texts.select("key", "first", "copies"), "key"))
    own = documents.select(row_key(doc_id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = own.join(written(asked.select("first.row")), "row", "left_semi")

    def sets(batches):
        for batch in small_batches(batches):
            found = [grams(t, n) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh128_digest(g.tobytes()) for g in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))], ["key", "grams"])

    full = chosen.select("text").mapInArrow(released(sets), "key binary, grams array<long>").groupBy("key").agg(F.any_value("grams").alias("grams"))
    members = written(asked.join(full, "key").select("group", "key", "copies", "grams"))
    found = written(compared(members, threshold))
    counts = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    forest = found.where("other IS NOT NULL").select("key", "other")
    tied = components(forest, ends(forest))
    named = texts.select("key", "first", "copies").join(tied, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = written(named.join(counts, "key", "left"))
    smallest = named.groupBy("label").agg(F.min("first").alias("class"))
    per_text = named.join(smallest, "label").select("key", F.col("class.id").alias("class_id"), F.col("class.row").alias("class_row"), "copies",
                                                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    return signed.select("row", "doc_id", "key").join(written(per_text), "key").select("row", "doc_id", "class_id", "class_row", "links", "text_links", "copies")


def classes(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links, text_links, copies): one row per document; options as for `memberships`."""
    return memberships(documents, **options).select("doc_id", "class_id", "links", "text_links", "copies")


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first document of every class, with all its columns; of equal rows one."""
    kept = written(memberships(documents, doc_id, text, **options).select(F.col("class_row").alias("__row")).distinct())
    rows = documents.withColumn("__row", row_key(doc_id, text)).join(kept, "__row", "left_semi")
    return rows.dropDuplicates(["__row"]).select(documents.columns)
