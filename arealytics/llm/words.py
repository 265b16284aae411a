"""Words of many texts in one buffer, hashed all at once with numpy.

Texts are joined by single spaces, so a run of words is a slice of the buffer. A hash decides where text is cut or what is looked up, and never
alone which words are equal.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

SEGMENT, LONG = 1 << 17, 4096  # bytes hashed at a time; longer words are hashed on their own
_STEP = 0x9E3779B97F4A7C15


@cache
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random code per byte; powers of an odd step and of its inverse, modulo 2**64."""
    inverse = pow(_STEP, -1, 1 << 64)
    powers = [np.cumprod(np.array([1] + [x] * SEGMENT, np.uint64)) for x in (_STEP, inverse)]
    return np.random.default_rng(11 + seed).integers(1, 2 ** 63, 256, dtype=np.uint64), *powers


def mix(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    out = (values ^ more) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Words:
    """The words of texts without leading, trailing or doubled spaces. `first` and `last` bound each text's words."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b" ".join([t for t in texts if t])
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.last = np.cumsum(counts)
        self.first = self.last - counts
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        some = [0] if self.buffer else []
        self.starts = np.concatenate([some, gaps + 1]).astype(np.int64)
        self.ends = np.concatenate([gaps, [len(self.buffer)] if self.buffer else []]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def run(self, at: int, end: int) -> bytes:
        """The words from `at` to `end` (exclusive), with their spaces."""
        return self.buffer[self.starts[at]:self.ends[end - 1]]

    def marks(self, mark: bytes) -> np.ndarray:
        """Which words are the given single byte."""
        out = self.ends - self.starts == 1
        out[out] = self.bytes[self.starts[out]] == mark[0]
        return out

    def hashes(self, seed: int = 0) -> np.ndarray:
        codes, powers, inverse = _tables(seed)
        out, at = np.zeros(len(self), np.uint64), 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SEGMENT, "right")))
            base, stop = self.starts[at], self.ends[end - 1]
            if stop - base <= SEGMENT:
                sums = np.zeros(stop - base + 1, np.uint64)
                np.cumsum(codes[self.bytes[base:stop]] * powers[:stop - base], out=sums[1:])
                starts = self.starts[at:end] - base
                out[at:end] = (sums[self.ends[at:end] - base] - sums[starts]) * inverse[starts]
            at = end
        sizes = self.ends - self.starts
        out = mix(mix(out, sizes.astype(np.uint64)), np.uint64(seed))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = xxhash.xxh64_intdigest(self.buffer[self.starts[i]:self.ends[i]], seed)
        return out

    def grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of `size` words, across the ends of texts too; the caller leaves those out."""
        n = max(0, len(hashes) - size + 1)
        out = hashes[:n]
        for i in range(1, size):
            out = mix(out, hashes[i:n + i])
        return out


def parts(texts, most: int):
    """Texts in lists of about `most` bytes; a longer one is a list of its own. Items are texts or tuples that end in one."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[-1] if isinstance(item, tuple) else item)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
