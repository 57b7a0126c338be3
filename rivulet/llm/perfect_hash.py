"""A minimal perfect hash of 64-bit keys over numpy arrays, with the keys stored by slot, and sparse sums of counts.

Keys are thrown at a bit array of twice their number; those alone in their place set its bit, the others go on to the
next, smaller array. The slot of a key is the number of bits set before its own: n keys take the slots 0 to n - 1. Any
other key lands somewhere as well, so the key stored at the slot is compared: a key that was not built in has slot -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of a chunk of counts.
CHUNK = 1 << 16
COUNTS = "chunk long, data binary"


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys, their bits mixed."""
    h = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """keys: distinct."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, ranked = keys.astype(np.uint64), 0
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = (mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            bits = np.packbits(once, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, ranked + np.cumsum(ones) - ones))
            ranked += int(ones.sum())
            left = left[~once[at]]
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[self._place(keys.astype(np.uint64))] = keys

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lands; -1 where no array holds its bit."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = mixed(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = bits[word]
            met = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & (np.uint64(1) << bit) - np.uint64(1))
            out[left[met]] = before[word[met]] + below[met]
            left = left[~met]
            if not len(left):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 of keys that were not built in."""
        at = self._place(keys)
        at[at >= 0] = np.where(self.keys[at[at >= 0]] == keys[at >= 0], at[at >= 0], -1)
        return at


def packed(places: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Ascending places and their counts as (chunk, bytes): the width of a count, the places within the chunk, the counts."""
    chunks, starts = np.unique(places // CHUNK, return_index=True)
    for chunk, start, end in zip(chunks.tolist(), starts.tolist(), [*starts.tolist(), len(places)][1:], strict=True):
        own = counts[start:end]
        kind = np.min_scalar_type(int(own.max()))
        yield chunk, bytes([kind.itemsize]) + (places[start:end] - chunk * CHUNK).astype(np.uint16).tobytes() + own.astype(kind).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // (2 + data[0])
    return np.frombuffer(data, np.uint16, n, 1), np.frombuffer(data, f"u{data[0]}", n, 1 + 2 * n)


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for data in table["data"]:
        places, counts = unpacked(data.as_py())
        total[places] += counts.astype(np.int64)
    at = np.flatnonzero(total)
    rows = list(packed(at, total[at]))
    chunk = table["chunk"][0].as_py()
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})


def tree_sum(rows: DataFrame) -> DataFrame:
    """rows (chunk, data) to one row a chunk, the sum: first about the root of the tasks' number together, then those."""
    fan = isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    dealt = rows.withColumn("node", F.spark_partition_id() % fan)
    return dealt.groupBy("chunk", "node").applyInArrow(_sum, COUNTS).groupBy("chunk").applyInArrow(_sum, COUNTS)
