"""Phrase collocations per language by prefix-free parsing.

1. Every text is a stream of words and piece marks. A window of ORDER - 1 tokens whose hash is divisible by `spacing` starts a chunk; a chunk runs on
   over the first ORDER - 1 tokens of the next one, so that every phrase lies whole in the chunk in which it starts, and only there.
   Copied text is cut alike wherever it stands.
2. Chunks with their number of own tokens are the keys of the dictionary, their parse frequencies its values: one shuffle, combined before it.
3. All counts come from distinct chunks, weighted by frequency; a phrase counts where it starts, so overlaps count once. Two passes of
   counters of fixed size (sketch.reached) first rule out words, then longer phrases, that cannot be frequent; the rest is counted exactly.
4. Cuts are joined to the counts of their parts; the lowest score of a phrase's cuts is its score.

Defined results: NULL texts are empty, a NULL language is `und`; case is folded for A-Z only; repeated rows and rows without an id count like others;
texts of any length are cut into chunks; equal scores are ordered by count, then phrase in byte order, so ranks have no ties; an empty table,
or one without frequent phrases, gives no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import best_ranked, released, written
from .words import Words, mix, parts

ORDER, MARK, LANG_SEED = 5, b".", 7
_FOLD = bytes(ord(".") if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
PART_BYTES, MOST_HELD = 3_000_000, 400_000


def stream_of(text: bytes) -> bytes:
    """Words, and a mark wherever a piece ends, with one space between; no word holds a mark."""
    return b" ".join(text.translate(_FOLD).replace(MARK, b" . ").split())


def parse(texts: list[bytes], spacing: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of streams, and for each chunk its first token, the end of its own tokens and its end."""
    words, near = Words(texts), ORDER - 1
    grams = words.grams(words.hashes(), near)
    text_end = np.repeat(words.last, words.last - words.first)
    place = np.arange(len(words))
    begins = np.zeros(len(words), bool)
    begins[:len(grams)] = ((grams >> np.uint64(20)) % np.uint64(spacing) == 0) & (place[:len(grams)] + near <= text_end[:len(grams)])
    begins[words.first[words.first < words.last]] = True
    starts = np.flatnonzero(begins)
    own = np.append(starts[1:], len(words))[:len(starts)]
    return words, starts, own, np.minimum(own + near, text_end[starts])


def dictionary(documents: DataFrame, lang: str, text: str, spacing: int) -> DataFrame:
    """(lang, own, words, chunk, n): distinct chunks with their own tokens, words among those, and frequencies."""
    def cut(batches):
        rows = ((lang, stream_of(body)) for batch in batches for lang, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()))
        for part in parts(rows, PART_BYTES):
            words, starts, own, ends = parse([t for _, t in part], spacing)
            marks = np.concatenate([[0], np.cumsum(words.marks(MARK))])
            langs = [part[i][0] for i in np.searchsorted(words.last, starts, "right")]
            found = Counter(zip(langs, (own - starts).tolist(), (own - starts - marks[own] + marks[starts]).tolist(), map(words.run, starts.tolist(), ends.tolist())))
            if found:
                columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], ["lang", "own", "words", "chunk", "n"])

    read = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(released(cut), "lang string, own int, words int, chunk binary, n long").groupBy("lang", "own", "words", "chunk").agg(F.sum("n").alias("n"))


class _Part:
    """Some chunks of one language, laid end to end."""

    def __init__(self, lang: str, chunks: list[tuple[int, int, bytes]]):
        self.lang, self.words = lang, Words([c for _, _, c in chunks])
        sizes = self.words.last - self.words.first
        self.left = np.repeat(self.words.last, sizes) - np.arange(len(self.words))
        self.h = self.words.hashes()
        self.first = mix(self.h, np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), LANG_SEED)))
        self.weight = np.repeat(np.array([n for _, n, _ in chunks], np.int64), sizes)
        self.own = np.arange(len(self.words)) < np.repeat(self.words.first + [o for o, _, _ in chunks], sizes)
        self.word = ~self.words.marks(MARK)

    def runs(self, usable: np.ndarray) -> np.ndarray:
        """How many usable tokens stand in a row from each place, within its chunk, up to ORDER."""
        out = np.zeros(len(usable), np.int8)
        alive = usable
        for size in range(1, ORDER + 1):
            out += alive
            alive = alive & np.append(usable[size:], np.zeros(min(size, len(usable)), bool))
        return np.minimum(out, self.left)

    def longer(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of one token more (those past the end are meaningless and never used)."""
        return mix(values, np.append(self.h[size - 1:], np.zeros(min(size - 1, len(self.h)), np.uint64)))


def _parts(batches):
    """The chunks of a task, by language, in parts of bounded size."""
    groups: dict[str, list] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, own, n, chunk in zip(*(batch.column(c).to_pylist() for c in ("lang", "own", "n", "chunk"))):
            groups.setdefault(lang, []).append((own, n, chunk))
            sizes[lang] += len(chunk)
        if sizes.total() > PART_BYTES:
            for lang, chunks in groups.items():
                for part in parts(chunks, PART_BYTES):
                    yield _Part(lang, part)
            groups, sizes = {}, Counter()
    for lang, chunks in groups.items():
        yield _Part(lang, chunks)


def frequent(chunks: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, phrase, f): every phrase of 1 to ORDER words with at least `least` occurrences."""
    spark, floor = chunks.sparkSession, min(least, 255)

    def words(batches):
        for part in _parts(batches):
            at = part.own & part.word
            yield part.first[at], part.weight[at]

    single = spark.sparkContext.broadcast(sketch.reached(chunks, words, bits, floor))

    def phrases(batches):
        for part in _parts(batches):
            runs = part.runs(part.word & sketch.holds(single.value, part.first))
            values = part.first
            for size in range(2, ORDER + 1):
                values = part.longer(values, size)
                at = part.own & (runs >= size)
                yield values[at], part.weight[at]

    several = spark.sparkContext.broadcast(sketch.reached(chunks, phrases, bits, floor))

    def count(batches):
        held: dict[tuple[str, bytes], int] = {}
        for part in _parts(batches):
            for phrase, f in _counted(part, single.value, several.value):
                held[part.lang, phrase] = held.get((part.lang, phrase), 0) + f
            if len(held) > MOST_HELD:
                yield _sums(held)
                held = {}
        yield _sums(held)

    def _sums(held):
        langs, phrases = zip(*held) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "phrase", "f"])

    # Every task hands on most frequent phrases once, so there are as many tasks as can run at a time, not as many as there are splits.
    wide = chunks.coalesce(max(spark.sparkContext.defaultParallelism, 1))
    found = wide.mapInArrow(released(count), "lang string, phrase binary, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _numbers(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal words get equal numbers. Two independent hashes must agree on which are equal; where they do not, the words decide."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    second = words.hashes(1)
    if (second[first][number] != second).any():
        names: dict[bytes, int] = {}
        return np.array([names.setdefault(words.run(i, i + 1), len(names)) for i in range(len(words))], np.int64), len(names)
    return number, len(first)


def _counted(part: _Part, single: np.ndarray, several: np.ndarray):
    """(phrase, count): exact counts of the part's phrases that the counters leave possible. Phrases are numbered by (number of the
    shorter phrase, last word)."""
    ids, kinds = _numbers(part.words, part.h)
    able = part.word & sketch.holds(single, part.first)
    runs, values = part.runs(able), part.first
    number, alive = ids, able
    for size in range(1, ORDER + 1):
        if size > 1:
            values = part.longer(values, size)
            at = np.flatnonzero(alive & np.append(alive[1:], False) & (runs >= size))
            at = at[sketch.holds(several, values[at])]
            alive = np.zeros(len(ids), bool)
            alive[at] = True
            _, place = np.unique(number[at] * kinds + ids[at + size - 1], return_inverse=True)
            number = np.full(len(ids), -1, np.int64)
            number[at] = place
        at = np.flatnonzero(alive & part.own)
        if not len(at):
            continue
        _, first, inverse = np.unique(number[at], return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, inverse, part.weight[at])
        starts = at[first]
        yield from zip(map(part.words.run, starts.tolist(), (starts + size).tolist()), sums.tolist())


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no equally frequent longer candidate holds."""
    several = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).join(totals, "lang")
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "n", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: f"CAST({c} AS DECIMAL(19,0))" for c in "anlr"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {wide['a']} * CAST(n AS DECIMAL(15,0))) DIV ({wide['l']} * {wide['r']})").cast("long")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # A phrase inside an equally frequent longer one is also inside one that is longer by one word and as frequent.
    held = several.where(F.size("words") > 2).select("lang", F.col("f").alias("a"), F.explode(F.array(
        F.array_join(F.slice("words", 1, F.size("words") - 1), " "), F.array_join(F.slice("words", 2, F.size("words") - 1), " "))).alias("phrase"))
    return lowest.join(held, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def mine(documents: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, top: int = 2000, spacing: int = 20, bits: int = 25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases. `bits` sizes the counters (four times 2**bits bytes per task while counting)."""
    chunks = written(dictionary(documents, lang, text, spacing))
    counts = written(frequent(chunks, least, bits))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
    found = scored(counts, totals)
    return best_ranked(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
