"""Packing documents into sequences: linear grouping, few-size configurations, then best fit of the small pieces.

Lengths are at most the capacity, so a table of counts per length (at most `capacity` rows, whatever the input) is all the planner sees:

1. pieces of full length fill a sequence each;
2. large lengths are dealt into groups of equal cardinality and rounded up to the longest of the group; the configurations of these few
   sizes that use the fewest sequences come from a linear programme (columns priced by an exact knapsack), used in whole multiples;
3. actual documents replace the rounded sizes, longest first, and what no whole multiple took is placed by best fit;
4. small pieces go, longest first, each where it leaves the least room.

The plan is a list of runs (length, first rank, count, first sequence, offset): pieces of one length, ranked, lie in consecutive sequences at
one offset. Its size depends on the number of lengths, not of documents. Ranks within a length are counted in two levels, so that a
length that a third of all pieces share is dealt over many tasks.

Defined results: a NULL text counts as empty and is the closing id alone; repeated rows are packed as often as they occur; rows without an
id are packed too; an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, released, written

CAPACITY, GROUPS, SMALL = 2048, (96, 48, 24, 12), 8
KEPT_WORDS, BATCH_CHARS = 150_000, 2_000_000  # a worker remembers at most so many runs, or those of the texts at hand
LONGEST_SPACE, OTHERS = 100_000, re.compile("[^\x00-\u024f]").search
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plain_latin(text: str) -> bool:
    """Latin letters and signs only, and no stretch of white space that overflows the quicker library's stack."""
    return (text.isascii() or not OTHERS(text)) and (len(text) < LONGEST_SPACE or max(map(len, re.findall(r"\s+", text)), default=0) < LONGEST_SPACE)


class WordIds:
    """Token ids of texts as little-endian bytes. Texts of Latin letters and signs, which every release of Unicode splits alike, are encoded
    whole by the quicker of two libraries over the same vocabulary. Others are cut: a single space with non-spaces on both sides is a token
    boundary for byte-level BPE with leading spaces, so runs between such spaces are encoded once and remembered, Latin ones by the quicker
    library and all others by `tokenizers`. A text that holds one of the vocabulary's own marks is given to `tokenizers` as it is."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.marks = sorted(special)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(letters[c] for c in token): number for token, number in self.tokenizer.get_vocab().items() if token not in special}
        self.quick = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        [self.line_break] = self.quick.encode_ordinary("\n")
        self.known: dict[str, bytes] = {}  # runs as they stand
        self.after: dict[str, bytes] = {}  # runs after a space, kept without it

    def _encoded(self, runs: list[str]) -> list[bytes]:
        """Runs without inner white space are joined by line breaks, each of which is one id of its own, and encoded in one call."""
        out: list = [None] * len(runs)
        joined, other = [], []
        for i, run in enumerate(runs):
            if run and plain_latin(run):
                body = run[1:] if run[0] == " " else run
                if body and body.split() == [body]:
                    joined.append(i)
                else:
                    out[i] = np.array(self.quick.encode_ordinary(run), dtype="<u4").tobytes()
            else:
                other.append(i)
        for at in range(0, len(joined), 100_000):
            part = joined[at:at + 100_000]
            ids = np.array(self.quick.encode_ordinary("\n".join([runs[i] for i in part])), dtype="<u4")
            raw, start = ids.tobytes(), 0
            for i, end in zip(part, [*(np.flatnonzero(ids == self.line_break) * 4).tolist(), len(raw)]):
                out[i] = raw[start:end]
                start = end + 4
        for i, got in zip(other, self.tokenizer.encode_batch_fast([runs[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(got.ids, dtype="<u4").tobytes()
        return out

    @staticmethod
    def runs(text: str) -> list[str]:
        """The text cut before every single space that has a non-space on both sides."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for part in parts[1:]:
            if part and not part[0].isspace() and held and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        out.append(held)
        return out

    def forget(self) -> None:
        self.known, self.after = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if any(m in t for m in self.marks)]
        hidden = set(marked)
        rest = [i for i, t in enumerate(texts) if i not in hidden and not plain_latin(t)]
        out: list = [None] * len(texts)
        for i, ids in zip(rest, self._unmarked([texts[i] for i in rest])):
            out[i] = ids
        for i in set(range(len(texts))).difference(hidden, rest):
            out[i] = np.array(self.quick.encode_ordinary(texts[i]), dtype="<u4").tobytes()
        for i in marked:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _unmarked(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        spaced = set()
        for runs in cut:
            spaced.update(runs[1:])
        whole = {runs[0] for runs in cut}
        # A run that is empty or ends in white space stands beside a space that is no boundary: its texts are cut the careful way.
        bad = {r for r in spaced.difference(self.after) if r != r.strip() or not r} | {r for r in whole if r != r.rstrip()}
        plain = [bad.isdisjoint(runs) or len(runs) == 1 for runs in cut] if bad else [True] * len(cut)
        if not all(plain):
            cut = [runs if p else self.runs(t) for t, runs, p in zip(texts, cut, plain)]
            whole = {runs[0] for runs in cut}.union(*[runs for runs, p in zip(cut, plain) if not p])
        first, later = list(whole.difference(self.known)), list(spaced.difference(self.after, bad))
        if len(self.known) + len(self.after) + len(first) + len(later) > KEPT_WORDS:  # what these texts use again stays
            self.known = {r: self.known[r] for r in whole if r in self.known}
            self.after = {r: self.after[r] for r in spaced if r in self.after}
        self.known.update(zip(first, self._encoded(first)))
        self.after.update(zip(later, self._encoded([" " + r for r in later])))
        known, after = self.known.__getitem__, self.after.__getitem__
        return [known(runs[0]) + b"".join(map(after, runs[1:])) if p else b"".join(map(known, runs)) for runs, p in zip(cut, plain)]


_ENCODERS: dict[str, WordIds] = {}


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces: full ones, and the first one shorter if the length is no multiple."""
    n = len(ids) // 4
    first = n if n <= capacity else (n % capacity or capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, ids[4 * a:4 * b]) for a, b in zip(starts, [*starts[1:], n])]


def pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents, each with the closing id at its end."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    end = int(closing).to_bytes(4, "little")

    def made(batches):
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = WordIds(vocabulary)
            give_back()  # reading a vocabulary takes more than it leaves
        encoder = _ENCODERS[vocabulary]
        try:
            yield from encoded(encoder, batches)
        finally:
            encoder.forget()  # a worker that waits for its next task keeps the vocabulary only

    def encoded(encoder, batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = np.cumsum([len(t) for t in texts]) // BATCH_CHARS
            for part in np.unique(sizes):
                at = np.flatnonzero(sizes == part)
                row, rest, own_ids = [], [], []
                for i, ids in zip(at.tolist(), encoder.encode([texts[i] for i in at])):
                    for number, (start, own) in enumerate(cut_pieces(ids + end, capacity)):
                        row.append(i)
                        rest.append((number, start, len(own) // 4, zlib.crc32(own)))
                        own_ids.append(np.frombuffer(own, "<i4") if with_ids else None)
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rest), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own_ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    read = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return read.mapInArrow(released(made), PIECES + (", ids array<int>" if with_ids else ""))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(number of each size, times): configurations used in whole multiples so that few sequences meet the demand; it may be left short."""
    k = len(sizes)
    if not k:
        return []
    columns = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * k):
        values = np.linalg.solve(columns.T, np.ones(k))
        gain, picked = np.zeros(capacity + 1), []
        for i, s in enumerate(sizes):  # bounded knapsack: how often each size is taken at each room
            best, times = gain.copy(), np.zeros(capacity + 1, dtype=np.int64)
            for n in range(1, capacity // s + 1):
                tried = gain[:capacity + 1 - n * s] + n * values[i]
                better = tried > best[n * s:] + 1e-12
                best[n * s:][better], times[n * s:][better] = tried[better], n
            gain = best
            picked.append(times)
        if gain[capacity] <= 1 + 1e-9:
            break
        room, new = capacity, np.zeros(k)
        for i in range(k - 1, -1, -1):
            new[i] = picked[i][room]
            room -= int(new[i]) * sizes[i]
        used, step = np.linalg.solve(columns, np.array(demand, float)), np.linalg.solve(columns, new)
        ratio = np.where(step > 1e-12, used / np.where(step > 1e-12, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    used = np.linalg.solve(columns, np.array(demand, float))
    return [(tuple(int(round(x)) for x in columns[:, j]), int(used[j] + 1e-9)) for j in range(k) if used[j] >= 1 - 1e-9]


class Plan:
    """Runs of placed pieces and the room left, as ranges of sequences with one room each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.next, self.capacity = dict(counts), dict.fromkeys(counts, 0), capacity
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.rooms: list[int] = []  # the rooms in use, sorted
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next[length], count, sequence, offset))
        self.next[length] += count
        self.left[length] -= count

    def offer(self, room: int, sequence: int, count: int) -> None:
        if room not in self.open:
            insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append((sequence, count))

    def fit(self, length: int) -> None:
        """Best fit of all pieces of this length that are left."""
        while self.left[length]:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                sequence, count = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
            else:
                each = self.capacity // length
                room, count = self.capacity, -(-self.left[length] // each)
                sequence, self.sequences = self.sequences, self.sequences + count
            taken = min(count, self.left[length])
            self.place(length, taken, sequence, self.capacity - room)
            self.offer(room - length, sequence, taken)
            if taken < count:
                self.offer(room, sequence + taken, count - taken)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """The packing plan for the number of pieces of each length, by the number of groups that needs the fewest sequences."""
    return min((_grouped(counts, capacity, n, small) for n in groups), key=lambda plan: plan.sequences).runs


def _grouped(counts: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    plan = Plan(counts, capacity)
    if counts.get(capacity):
        plan.place(capacity, counts[capacity], 0, 0)
        plan.sequences = counts[capacity]
    large = sorted((n for n in counts if capacity // small < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    share, members, sizes, demand, seen, at = max(1, -(-total // groups)), [], [], [], 0, -1
    for n in large:  # equal cardinality: a group ends where another share of the pieces is reached
        if seen // share != at:
            at = seen // share
            members.append([])
            sizes.append(n)
            demand.append(0)
        members[-1].append(n)
        demand[-1] += counts[n]
        seen += counts[n]
    for config, times in configurations(sizes, demand, capacity):
        times = min([times, *[sum(plan.left[n] for n in members[i]) // c for i, c in enumerate(config) if c]])
        # Each slot of the configuration takes the longest pieces left of its group; the runs are cut wherever a length changes.
        ranges = [(plan.sequences, times, 0)]
        plan.sequences += times
        for i, c in enumerate(config):
            for _ in range(c):
                cut = []
                for sequence, count, offset in ranges:
                    while count:
                        n = next(m for m in members[i] if plan.left[m])
                        taken = min(count, plan.left[n])
                        plan.place(n, taken, sequence, offset)
                        cut.append((sequence, taken, offset + n))
                        sequence, count = sequence + taken, count - taken
                ranges = cut
        for sequence, count, offset in ranges:
            plan.offer(capacity - offset, sequence, count)
    for n in sorted((n for n in counts if n < capacity), reverse=True):
        plan.fit(n)
    return plan


def ranked(made: DataFrame, rows: int = 20_000) -> DataFrame:
    """The pieces with a rank from 0 within their length: counted per (length, slice of hashes), then within the slice."""
    total = made.count()
    slices = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, total // rows)))
    made = made.withColumn("slice", slices)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = made.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return made.join(counts, ["length", "slice"]).withColumn("rank", F.col("earlier") + F.row_number().over(inside) - 1).drop("slice", "earlier")


def placed(spark: SparkSession, made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. The runs are at most a few per pair of lengths and are joined by their length and first rank."""
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan_runs(counts, capacity)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("run_length", "first", "count", "sequence", "offset")])
    table = spark.createDataFrame(runs, schema)
    by_length = table.groupBy("run_length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "offset"))).alias("runs"))
    joined = ranked(made).join(F.broadcast(by_length), F.col("length") == F.col("run_length"))
    # The run of a piece is the last one that begins at or before its rank.
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    joined = joined.withColumn("run", run)
    return joined.withColumn("sequence_id", F.col("run.sequence") + F.col("rank") - F.col("run.first")).withColumn("offset", F.col("run.offset")).drop("run", "runs", "run_length", "rank")


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents as pieces with a sequence and an offset; with_ids adds the token ids, so that a sequence is its pieces' ids by offset."""
    made = written(pieces(documents, doc_id, text, vocabulary, capacity, with_ids=with_ids))
    return placed(documents.sparkSession, made, capacity)
