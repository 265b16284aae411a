"""Counters of a fixed size over hashed keys: what they show below a threshold is proven, as a counter never counts too little.

Every task fills its own counters, cut off at the threshold, and hands on compressed slices; slices are added up by their number, and
only one bit per counter (has it reached the threshold?) returns. The size is a parameter and does not grow with the input: when more keys
come than counters, more bits are set and fewer keys are ruled out, but no key that reaches the threshold ever is.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import released

SLICES = 64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def places(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each 64-bit value in one row of 2**bits counters."""
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(_ODD[row])
    return mixed >> np.uint64(64 - bits)


def reached(frame: DataFrame, hashed: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple[np.ndarray, np.ndarray]]], bits: int, threshold: int, rows: int = 1) -> np.ndarray:
    """(rows, 2**bits / 8) packed bits: which counters reach the threshold (at most 255). `hashed` turns a
    task's batches into pairs of values and weights."""
    def fill(batches):
        counts, open_adds = np.zeros((rows, 1 << bits), np.uint8 if threshold == 1 else np.uint32), 0
        for values, weights in hashed(batches):
            if threshold == 1:
                for row in range(rows):
                    counts[row][places(values, row, bits)] = 1
                continue
            small = np.minimum(weights, threshold).astype(np.uint32)
            if open_adds + len(values) > (1 << 32) // (threshold + 1) - threshold:
                np.minimum(counts, threshold, out=counts)
                open_adds = 0
            open_adds += len(values)
            for row in range(rows):
                np.add.at(counts[row], places(values, row, bits), small)
        packer = zstandard.ZstdCompressor(level=1)
        for number, part in enumerate(np.minimum(counts, threshold, out=counts).reshape(rows * SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packer.compress(part.astype(np.uint8).tobytes())], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for number, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(opener.decompress(packed), np.uint8).astype(np.uint16)
                sums[number] = np.minimum(sums[number] + part, threshold) if number in sums else part
        for number, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(part >= threshold).tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    found = frame.mapInArrow(released(fill), schema).repartition("slice").mapInArrow(released(add), schema).collect()
    out = np.zeros((rows * SLICES, (1 << bits) // SLICES // 8), np.uint8)
    for row in found:
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(rows, -1)


def holds(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether all counters of each value reached the threshold."""
    bits = (packed.shape[1] * 8).bit_length() - 1
    out = np.ones(len(values), bool)
    for row, own in enumerate(packed):
        at = places(values, row, bits)
        out &= (own[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out
