"""A shuffle through a buffer, without passing rows from task to task.

The buffer is filled with the first rows in order. Each step draws one of its slots, gives the row that lies there and
puts the next row in its place; when none is left, the others follow in the order in which their slots would be drawn
next. A draw is a hash of the seed and the step, so every task can state the draws of any steps by itself: a row leaves
at the next step that draws the slot it was put into. No row comes more than window - 1 places before its own, and any
row may stay for long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows whose places are found at once, at least; of a buffer with more slots, four times their number.
BLOCK = 1 << 16
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The public 32-bit finalizer of MurmurHash3, over numbers below 2^32."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & LOW
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & LOW
    return x ^ (x >> np.uint64(16))


class Buffer:
    """Places of rows that pass a buffer of `window` slots; total: rows of the stream, None where it is not known.
    Memory is some 16 numbers a slot."""

    def __init__(self, window: int, seed: int, total: int | None):
        self.window = window if total is None else max(1, min(window, total))
        self.total = total
        low, high = np.array([seed & 0xFFFFFFFF], np.uint64), np.array([(seed >> 32) & 0xFFFFFFFF], np.uint64)
        self.keys = [mixed(low ^ mixed(high) ^ np.uint64(salt)) for salt in (0, 0x9E3779B9)]
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, np.int64))

    def draws(self, first: int, last: int) -> np.ndarray:
        """The slots drawn at steps first to last - 1."""
        step = np.arange(first, last, dtype=np.uint64)
        x, y = (mixed((step & LOW) ^ mixed((step >> np.uint64(32)) ^ key)) for key in self.keys)
        return (((x << np.uint64(31)) | (y >> np.uint64(1))) % np.uint64(self.window)).astype(np.int64)

    def next_draws(self, step: int) -> np.ndarray:
        """For each slot the first step from this one on that draws it."""
        out, many = np.full(self.window, -1, np.int64), max(1024, min(self.window, 1 << 20))
        while (out < 0).any():
            slots, own = self.draws(step, step + many), np.full(self.window, -1, np.int64)
            own[slots[::-1]] = np.arange(step + many - 1, step - 1, -1)  # of equal slots the last written, so the first drawn
            out = np.where(out < 0, own, out)
            step += many
        return out

    @cached_property
    def _left(self) -> np.ndarray:
        """Of each slot, its turn among those that are full when no row is left to put."""
        turn = np.empty(self.window, np.int64)
        turn[np.argsort(self.next_draws(self.total - self.window))] = np.arange(self.window)
        return turn

    def leaving(self, first: int, last: int) -> np.ndarray:
        """The places of rows first to last - 1, or, without a total, numbers in the same order."""
        w = self.window
        slot = np.concatenate([np.arange(first, min(last, w)), self.draws(max(first, w) - w, max(last, w) - w)])
        order = np.argsort(slot, kind="stable")
        again = slot[order[1:]] == slot[order[:-1]]
        at = np.full(len(slot), -1, np.int64)
        at[order[:-1][again]] = first + order[1:][again] - w
        ends = at < 0
        at[ends] = self.next_draws(max(0, last - w))[slot[ends]]
        if self.total is not None:
            late = at >= self.total - w
            if late.any():
                at[late] = self.total - w + self._left[slot[late]]
        return at

    def places(self, pos: np.ndarray) -> np.ndarray:
        """The places of rows in any order; those of a block that follow one another are found once."""
        size, out = max(BLOCK, 4 * self.window), np.empty(len(pos), np.int64)
        block = pos // size
        for b in np.unique(block):
            if self._held[0] != b:
                end = (b + 1) * size
                self._held = int(b), self.leaving(int(b * size), int(end if self.total is None else min(end, self.total)))
            own = block == b
            out[own] = self._held[1][pos[own] - b * size]
        return out


def place(pos: str, window: int, seed: int, total: int | None) -> Column:
    """Where the row at a position leaves the buffer. Only positions go to Python; rows should come in ascending order,
    as readers give them: in another order the result is the same and takes longer."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Buffer(window, seed, total)
        for batch in batches:
            yield pd.Series(own.places(batch.to_numpy(np.int64)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(pos)
