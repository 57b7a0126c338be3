"""Best-fit packing of token pieces into sequences by minimum bin slack.

Pieces of equal length are alike, so the bins are planned over the histogram of lengths (at most `capacity` rows,
whatever the corpus): each plan step takes the longest piece that is left and finds, by subset sums held in one big
integer, the fullest feasible combination of what is left; the combination is removed as often as the counts allow.
The plan says for every length which rank goes to which sequence and place. Ranks within a length are counted where
the pieces were cut and shifted by prefix sums over the parts, so no length, however common, meets in one task.

Null text counts as empty (the end id alone); an empty table gives no rows; repeated rows are packed as often as they
occur; further columns of the input are ignored; a null identifier stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty
from .words import WordIds

#: Characters of texts encoded at a time in a task, or one text that has more.
BLOCK = 4 << 20


def blocks(texts: list[str]) -> Iterator[slice]:
    """Stretches of texts of BLOCK characters at most, or one text."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, part, nth): pieces of at most capacity ids (little-endian, 32 bits each).

    nth numbers the pieces of one length within the part, the task that cut them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part = WordIds(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            keys, bodies = batch["id"].tolist(), batch["body"].tolist()
            for block in blocks(bodies):
                rows = []
                for key, ids in zip(keys[block], words.encode(bodies[block]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        n = len(own) // 4
                        rows.append((key, piece, start // 4, n, own, part, seen[n]))
                        seen[n] += 1
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids", "part", "nth"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("body"))
    pieces = rows.mapInPandas(run, "id string, piece int, start long, length long, ids binary, part int, nth long")
    return pieces.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def fullest(room: int, left: dict[int, int]) -> list[tuple[int, int]]:
    """(length, times) of the combination of what is left that fills room best: bitset subset sums, longest first."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((n for n, k in left.items() if k and n <= room), reverse=True):
        k, times = min(left[length], room // length), 1
        while k:
            times = min(times, k)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            k -= times
            times *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + times
            at -= length * times
    return sorted(chosen.items(), reverse=True)


@dataclass
class Plan:
    """Of each length: ranks from `rank` on go `each` to a sequence, from sequence `first` and offset `offset` on."""

    entries: dict[int, list[np.ndarray]]
    sequences: int


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    entries: dict[int, list[tuple]] = {n: [] for n in left}
    first = 0
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = dict(fullest(capacity - longest, left))
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            uses = min(left[n] // k for n, k in chosen.items())
            offset = 0
            for n, k in sorted(chosen.items(), reverse=True):
                entries[n].append((used[n], k, first, offset))
                used[n] += uses * k
                left[n] -= uses * k
                offset += n * k
            first += uses
    return Plan({n: list(np.array(e, np.int64).T) for n, e in entries.items() if e}, first)


def _placed(entries: dict[int, list[np.ndarray]]):
    def run(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            start, each, first, place = entries[int(n)]
            e = np.searchsorted(start, ranks[own], side="right") - 1
            past = ranks[own] - start[e]
            sequence[own] = first[e] + past // each[e]
            offset[own] = place[e] + past % each[e] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    run.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "sequence_id long, offset long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: tuple[Column | str, ...] = ("ids",),
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, payload, sequence_id, offset.

    payload: columns over `ids` that go with a piece; the ids themselves by default.
    """
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    pieces = materialise(pieces.select("id", "piece", "start", "length", "part", "nth", *payload), "pieces", compression="zstd")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("length", "part", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    place = _placed(plan(histogram, capacity).entries)
    ranked = pieces.join(shifts, ["length", "part"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    kept = [c for c in pieces.columns if c not in ("id", "piece", "start", "length", "part", "nth")]
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", *kept, "at.sequence_id", "at.offset")
