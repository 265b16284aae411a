"""Removal of long repeated passages with suffix automata over reference shards.

1. Anchors: of the word GRAM-grams in a window of `window` words, the leftmost one with the smallest hash. Equal windows have the same anchor at the
   same place, so a window can only repeat where its anchor does. Anchors are counted; those that occur twice set bits of a filter of
   fixed size, which is broadcast.
2. Passages: the windows that share one anchor occurrence, laid over each other, are a passage; every window lies in exactly one. Passages with
   shared anchors are the reference text. Equal ones are combined before and in the shuffle, and keep their frequency.
3. Shards: ranges of anchor hashes with a bounded number of passages. The task that gets a shard builds one suffix automaton over it (occurrences
   of a state: windows that end in it, weighted) and streams the passages through it: the matching statistics are the lengths of the
   longest suffix, at each place, that occurs at least twice. Where they reach `window`, the words of the window go.
   To send every automaton to every document would be quadratic; here text and automaton meet by their anchors. An anchor with a single
   distinct passage needs no automaton: the passage's frequency is the number of occurrences of its windows.
4. An anchor with more than HOT distinct passages is split: its windows become passages of their own, with their own hash as the anchor.
5. Spans return to the texts by passage and are applied once per distinct text.

Defined results: a NULL text is empty; words are cut at space and U+0009 to U+000D and never changed; texts of fewer than `window` words lose nothing;
repeated rows are copies of each other, so all their windows go; rows without an id are rows like others; any text length is allowed,
one text is handled by one task; an empty table gives no rows. `without_repeats` keeps all columns; one named like `into` is replaced.
"""
from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealytics.session import broadcast_if_small

from . import sketch
from .common import released, written
from .words import Words, parts

GRAM, HOT, SHARD_PASSAGES, PART_BYTES = 8, 1000, 1500, 3_000_000
_LOW = np.uint64((1 << 28) - 1)


def anchored(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of all passages of some texts: the anchor's hash, and the first and last window start among all words."""
    near, none = window - GRAM + 1, np.zeros(0, np.int64)
    windows = len(words) - window + 1
    if windows < 1:
        return none.astype(np.uint64), none, none
    grams = words.grams(words.hashes(), GRAM)
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # ties of the hash go to the left
    width = 1
    while 2 * width <= near:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    place = (np.minimum(low[:windows], low[near - width:near - width + windows]) & _LOW).astype(np.int64)
    ends = np.repeat(words.last, words.last - words.first)
    starts = np.arange(windows)
    starts = starts[starts + window <= ends[:windows]]  # windows inside one text
    if not len(starts):
        return none.astype(np.uint64), none, none
    place = place[starts]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[new]], starts[new], starts[np.append(new[1:], len(starts)) - 1]


class Automaton:
    """A suffix automaton over several word sequences; `seen` counts the windows that end in a state."""

    def __init__(self, window: int):
        self.window, self.next, self.link, self.length, self.seen = window, [{}], [-1], [0], [0]

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.seen.append(0)
        return len(self.next) - 1

    def _split(self, state: int, word, target: int) -> int:
        """The state for `state`'s words and `word`, cut off `target` if that holds longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        own = self._state(self.length[state] + 1, dict(self.next[target]))
        self.link[own] = self.link[target]
        self.link[target] = own
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = own
            state = self.link[state]
        return own

    def add(self, words: list, times: int) -> None:
        last, next_, link, length = 0, self.next, self.link, self.length
        for at, word in enumerate(words):
            target = next_[last].get(word)
            if target is not None:
                last = self._split(last, word, target)
            else:
                own = self._state(length[last] + 1, {})
                back = last
                while back >= 0 and word not in next_[back]:
                    next_[back][word] = own
                    back = link[back]
                if back >= 0:
                    link[own] = self._split(back, word, next_[back][word])
                last = own
            if at >= self.window - 1:
                self.seen[last] += times

    def close(self) -> None:
        """Occurrences of every state, and the longest repeated suffix below it."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for state in reversed(order[1:]):
            self.seen[self.link[state]] += self.seen[state]
        self.repeated = [0] * len(order)
        for state in order[1:]:
            self.repeated[state] = self.length[state] if self.seen[state] > 1 else self.repeated[self.link[state]]

    def statistics(self, words: list) -> list[int]:
        """At each place of a sequence, the length of the longest suffix up to there that occurs at least twice."""
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append(min(size, self.repeated[state]))
        return out


def spans(statistics: list[int], window: int) -> list[int]:
    """Maximal spans (start, end, start, end, ...) of words in windows that repeat."""
    out: list[int] = []
    for at, size in enumerate(statistics):
        if size >= window:
            if out and out[-1] >= at + 1 - window:
                out[-1] = at + 1
            else:
                out += [at + 1 - window, at + 1]
    return out


def _texts(batches):
    """Lists of (key, words of a text with one space between) of bounded size."""
    return parts(((key, b" ".join(text.split())) for batch in batches for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())), PART_BYTES)


def _passages(batches, window: int, shared: np.ndarray):
    """Per list of texts: their words, and text number, anchor, first and last window start of each passage whose anchor may be shared."""
    for part in _texts(batches):
        words = Words([t for _, t in part])
        anchors, first, last = anchored(words, window)
        some = sketch.holds(shared, anchors)
        first = first[some]
        yield part, words, np.searchsorted(words.last, first, "right"), anchors[some], first, last[some]


def _mark(passage: bytes) -> bytes:
    return hashlib.blake2b(passage, digest_size=16).digest()


def anchor_counts(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, n) of all passages."""
    def counted(batches):
        for part in _texts(batches):
            anchors, times = np.unique(anchored(Words([t for _, t in part]), window)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(times.astype(np.int64))], ["anchor", "n"])

    return texts.mapInArrow(released(counted), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def references(texts: DataFrame, window: int, shared) -> DataFrame:
    """(anchor, passage, n): distinct passages whose anchors may be shared."""
    def found(batches):
        for _, words, _, anchors, first, last in _passages(batches, window, shared.value):
            counts = Counter(zip(anchors.view(np.int64).tolist(), map(words.run, first.tolist(), (last + window).tolist())))
            anchors, passages = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(passages, pa.binary()), pa.array(counts.values(), pa.int64())], ["anchor", "passage", "n"])

    return texts.mapInArrow(released(found), "anchor long, passage binary, n long").groupBy("anchor", "passage").agg(F.sum("n").alias("n"))


def windows_of(passages: DataFrame, window: int) -> DataFrame:
    """(anchor, passage, n, own, mark, at): each window of the given passages as a passage of its own, with where it comes from."""
    def cut(batches):
        for batch in batches:
            rows = []
            for passage, n in zip(batch.column("passage").to_pylist(), batch.column("n").to_pylist()):
                words, mark = passage.split(), _mark(passage)
                for at in range(len(words) - window + 1):
                    own = b" ".join(words[at:at + window])
                    rows.append((int.from_bytes(_mark(own)[:8], "little", signed=True), own, n, _mark(own), mark, at))
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[at:at + 10_000]], schema)

    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.binary()), ("n", pa.int64()), ("own", pa.binary()), ("mark", pa.binary()), ("at", pa.int32())])
    return passages.mapInArrow(released(cut), "anchor long, passage binary, n long, own binary, mark binary, at int")


def matched(passages: DataFrame, window: int) -> DataFrame:
    """(mark, spans) of the distinct passages (anchor, passage, n) in which a window repeats."""
    shards = passages.agg(F.ceil(F.count("*") / SHARD_PASSAGES)).first()[0] or 1
    schema = pa.schema([("mark", pa.binary()), ("spans", pa.list_(pa.int32()))])

    def stream(shard: pa.Table) -> pa.Table:
        rows = list(zip(shard.column("anchor").to_pylist(), shard.column("passage").to_pylist(), shard.column("n").to_pylist()))
        alike = Counter(anchor for anchor, _, _ in rows)
        out, automaton, several = [], Automaton(window), []
        for anchor, passage, n in rows:
            words = passage.split()
            if alike[anchor] > 1:
                automaton.add(words, n)
                several.append((passage, words))
            elif n > 1:
                out.append((_mark(passage), [0, len(words)]))
        automaton.close()
        for passage, words in several:
            own = spans(automaton.statistics(words), window)
            if own:
                out.append((_mark(passage), own))
        return pa.table([[m for m, _ in out], [s for _, s in out]], schema=schema)

    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(stream, "mark binary, spans array<int>")


def repeated_spans(texts: DataFrame, window: int, bits: int) -> DataFrame:
    """(key, spans): the spans of words to remove from each of the texts (key, text) that has any, in no order."""
    twice = written(anchor_counts(texts, window).where("n > 1").select("anchor"))

    def once(batches):
        for batch in batches:
            values = batch.column("anchor").to_numpy().view(np.uint64)
            yield values, np.ones(len(values), np.int64)

    shared = texts.sparkSession.sparkContext.broadcast(sketch.reached(twice, once, bits, 1))
    found = written(references(texts, window, shared))
    anchors = written(found.groupBy("anchor").agg(F.count("*").alias("passages")).where(F.col("passages") > HOT).select("anchor"))
    hot = broadcast_if_small(anchors)
    whole = matched(found.join(hot, "anchor", "left_anti"), window)
    cut = written(windows_of(found.join(hot, "anchor", "left_semi"), window))
    single = matched(cut.groupBy("anchor", "passage").agg(F.sum("n").alias("n")), window).select("mark")
    pieces = cut.select("mark", "at", "own").join(single.withColumnRenamed("mark", "own"), "own")
    pieces = pieces.groupBy("mark").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + window))).alias("spans"))
    spans_of = written(whole.unionByName(pieces))

    def placed(batches):
        for part, words, text, _, first, last in _passages(batches, window, shared.value):
            marks = list(map(_mark, map(words.run, first.tolist(), (last + window).tolist())))
            keys = [part[i][0] for i in text.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array((first - words.first[text]).astype(np.int32)), pa.array(marks, pa.binary())], ["key", "first", "mark"])

    places = texts.mapInArrow(released(placed), "key binary, first int, mark binary").distinct()
    moved = places.join(spans_of, "mark").select("key", F.transform("spans", lambda s: s + F.col("first")).alias("spans"))
    return moved.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def applied(texts: DataFrame) -> DataFrame:
    """(key, n_words, n_removed, kept) of texts with their spans (NULL: none)."""
    def cut(batches):
        for batch in batches:
            out = []
            for key, text, gone in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                words, stay = text.split(), []
                at = 0
                for start, end in sorted(zip((gone or ())[::2], (gone or ())[1::2])):
                    stay += words[at:start]
                    at = max(at, end)
                stay += words[at:]
                out.append((key, len(words), len(words) - len(stay), b" ".join(stay)))
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["key", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(released(cut), "key binary, n_words long, n_removed long, kept binary")


def without_repeats(documents: DataFrame, text: str = "text", window: int = 35, into: str = "repeats", shown=None, bits: int = 26) -> DataFrame:
    """The documents with a struct `into` of n_words, n_removed and kept (the words that stay, joined by one space).

    `shown` turns the kept text into what is returned of it, before rows are joined (a digest, say); `bits` sizes the filter of anchors.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(body, 256))
    texts = documents.select(key.alias("key"), body.cast("binary").alias("text"))
    gone = repeated_spans(texts, window, bits)
    each = applied(texts.groupBy("key").agg(F.any_value("text").alias("text")).join(gone, "key", "left"))
    kept = F.col("kept").cast("string")
    each = each.select(F.col("key").alias("__text_key"), F.struct("n_words", "n_removed", (shown(kept) if shown else kept).alias("kept")).alias(into))
    return documents.drop(into).withColumn("__text_key", key).join(written(each), "__text_key").drop("__text_key")
