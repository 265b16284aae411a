"""Stupid-backoff language-model scores, computed relationally over hash-partitioned n-gram counts.

A document's score is the sum over its words of log S, with bigrams backing off to words:
S(w | v) = c(v w) / c(v) if c(v w) >= min_count, else alpha * c(w) / N; its first word takes c(w) / N. Counts are of all documents.

Tables and joins (all counts are exact):
1. texts are read once and written as parts: some thousands of texts each, as word hashes in sorted order and numbers into them;
2. a part asks for the corpus counts of its distinct words and pairs. A question goes to the bucket of its hash with its count in the part,
   so a frequent word or pair is one question per part and no bucket is hot;
3. a bucket adds up the counts of equal hashes and answers every part with the sums, in the order of its questions and without the hashes;
4. parts meet their answers. Buckets are ranges of hashes, so answers in the order of buckets belong to the part's sorted hashes, and
   every word's log S follows from them. A document lies in one part whole.
Questions cost about six bytes and answers less than one for each distinct pair of a part, whatever the number of buckets, so the shuffle grows as
the corpus does.

Defined results: words are lower-cased runs of letters, digits and underscores, known by a 64-bit hash; a text that is NULL or has no word
scores 0 with a NULL mean; repeated rows count as often as they occur, in counts and results; an empty table gives no rows; extra columns
are ignored.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

WORDS = re.compile(r"\w+")
BUCKET_ROWS, PART_CHARS, KEPT_WORDS = 1_500_000, 6_000_000, 100_000
HOT_WORDS = HOT_PAIRS = None  # not used: no word or pair is treated apart; tests set them
PAGE = "part long, bucket int, page binary"
TEXTS = -1  # the bucket of a part's own page
TYPES = [np.dtype(x) for x in ("<u8", "<i8", "<f8", "<i4", "<u4", "<u2", "<u1")]
_WORD: dict[str, int] = {}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed page: equal bytes of all numbers lie together."""
    head = np.array([len(arrays), *(x for a in arrays for x in (TYPES.index(a.dtype), len(a)))], dtype="<i8")
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def opened(page: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(page)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for kind, length in head:
        size = TYPES[kind].itemsize
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(TYPES[kind]).ravel())
        at += size * length
    return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def steps(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes, prepend=np.uint64(0))


def summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def parts(batches, chars: int):
    """(ids, words per text, word hashes) of texts in their order, in parts of bounded length."""
    ids, lengths, found, held = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if len(_WORD) > KEPT_WORDS:
                _WORD.clear()
            words = WORDS.findall(text.lower())
            try:
                own = np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))
            except KeyError:
                for w in set(words).difference(_WORD):
                    _WORD[w] = xxhash.xxh64_intdigest(w)
                own = np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))
            ids.append(doc_id)
            lengths.append(len(words))
            found.append(own)
            held += len(text)
            if held >= chars:
                yield ids, np.array(lengths, "<i8"), np.concatenate(found)
                ids, lengths, found, held = [], [], [], 0
    if ids:
        yield ids, np.array(lengths, "<i8"), np.concatenate(found)


def neighbours(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of every word, which words have one before them in the same text)."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.concatenate([[False], of[1:] == of[:-1]])[:len(of)]


def pairs_of(kinds: np.ndarray, numbers: np.ndarray, follows: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(follows)
    return pair_hash(kinds[numbers[at - 1]], kinds[numbers[at]])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, bucket, pages = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(bucket, pa.int32()), pa.array(pages, pa.binary())], ["part", "bucket", "page"])


def scores(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, n_tokens, score, mean_log): one row per document."""
    read = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = PART_CHARS

    def paged(batches):
        task = TaskContext.get().partitionId() << 32
        for number, (ids, lengths, words) in enumerate(parts(batches, chars)):
            kinds, numbers = np.unique(words, return_inverse=True)
            known = np.array([i is not None for i in ids], "<u1")
            page = packed(np.array([i or 0 for i in ids], "<i8"), known, lengths, steps(kinds), numbers.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([task + number]), pa.array([len(words)]), pa.array([page], pa.binary())], ["part", "n", "page"])

    # Only the written rows are read below, so that a part stays the same wherever it is used.
    texts = written(read.mapInArrow(released(paged), "part long, n long, page binary"))
    total = texts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    log_all, log_alpha = math.log(max(total, 1)), math.log(alpha)

    def asked(batches):
        for batch in batches:
            for part, page in zip(batch.column("part").to_pylist(), batch.column("page")):
                _, _, lengths, kinds, numbers = opened(page.as_py())
                kinds = summed(kinds)
                pairs, m = np.unique(pairs_of(kinds, numbers, neighbours(lengths)[1]), return_counts=True)
                n = np.bincount(numbers, minlength=len(kinds))
                ends = np.arange(buckets + 1)
                a, b = np.searchsorted(bucket_of(kinds, buckets), ends), np.searchsorted(bucket_of(pairs, buckets), ends)
                rows = [(part, i, packed(steps(kinds[a[i]:a[i + 1]]), n[a[i]:a[i + 1]].astype("<i8"), steps(pairs[b[i]:b[i + 1]]), m[b[i]:b[i + 1]].astype("<i8")))
                        for i in range(buckets) if a[i] < a[i + 1] or b[i] < b[i + 1]]
                for i in range(0, len(rows), 256):
                    yield _rows(rows[i:i + 256])

    def answered(table: pa.Table) -> pa.Table:
        """One bucket of questions: the counts of equal hashes added up, for words and for pairs, by question."""
        pages = [opened(page.as_py()) for page in table.column("page")]
        answers = []
        for at in (0, 2):
            hashes, ends = np.concatenate([summed(p[at]) for p in pages]), np.cumsum([len(p[at]) for p in pages])
            _, place = np.unique(hashes, return_inverse=True)
            counts = np.zeros(len(hashes), "<i8")
            np.add.at(counts, place, np.concatenate([p[at + 1] for p in pages]))
            answers.append(np.split(counts[place], ends[:-1]))
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches([_rows([(part, bucket, packed(*own)) for part, *own in zip(table.column("part").to_pylist(), *answers)])])

    def scored(table: pa.Table) -> pa.Table:
        """One part's texts and the answers to its questions."""
        rows = sorted(zip(table.column("bucket").to_pylist(), range(len(table))))
        [own, *answers] = [opened(table.column("page")[i].as_py()) for _, i in rows]
        ids, known, lengths, kinds, numbers = own
        kinds, (of_text, follows) = summed(kinds), neighbours(lengths)
        sums = np.zeros(len(lengths))
        if len(numbers):
            logs, pair_counts = np.log(np.concatenate([a[0] for a in answers])), np.concatenate([a[1] for a in answers])
            _, place = np.unique(pairs_of(kinds, numbers, follows), return_inverse=True)
            each = logs[numbers] - log_all
            at = np.flatnonzero(follows)
            n = pair_counts[place]
            each[at] = np.where(n >= min_count, np.log(n) - logs[numbers[at - 1]], log_alpha + each[at])
            sums = np.bincount(of_text, each, len(lengths))
        none = lengths == 0
        columns = [pa.array(ids, mask=known == 0), pa.array(lengths), pa.array(sums), pa.array(sums / np.maximum(lengths, 1), mask=none)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "score", "mean_log"])

    questions = texts.select("part", "page").mapInArrow(released(asked), PAGE)
    answers = questions.groupBy("bucket").applyInArrow(answered, PAGE)
    own = texts.select("part", F.lit(TEXTS).alias("bucket"), "page")
    return own.unionByName(answers).groupBy("part").applyInArrow(scored, "doc_id long, n_tokens long, score double, mean_log double")
