"""Document fingerprints by a randomised edit embedding.

Embedding: all texts are walked with the same random choices. At step j the character under the pointer is written
out, and a shared random bit of (j, character) says whether the pointer moves on. Texts a few edits apart fall into
step again after each edit, so edit distance becomes Hamming distance of what is written. The walk ends when the text
does: whole texts are embedded.

Bit sampling: slot s takes what is written at one position, the one with the least hash h_s among all positions of the
walk, so that walks of like length sample alike; with the GRAM - 1 characters written before it, as single characters
are alike by chance in one of a dozen places. A fingerprint is SLOTS such stretches, hashed to 1..255 (0 for an empty
text), in hexadecimal. Banding: consecutive slots form bands; two texts are candidates if they share a
band. Verification: candidates are compared on all slots; likeness is the share of equal slots, 0 for others.

Null text counts as empty; two empty texts are alike (1). Equal texts have equal fingerprints. An empty table gives
no rows; with one row its next document is itself. Identifiers are of any type that JSON can hold; rows of equal ones
follow each other by their place in the files, and rows without an identifier come first, in that order too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import FILE, ROW, materialise, placed, text_or_empty
from .simhash import _blocks, _by_group, _forest

SLOTS, BAND = 64, 2
#: Written characters that a slot takes.
GRAM = 4
#: Fingerprints that share a band are compared in blocks of so many.
BLOCK = 1024
#: Texts walked side by side, steps between two looks at which have ended, and texts left that are walked one by one.
LANES, STRIDE, FEW = 4096, 32, 24
#: The random choices repeat after so many steps (a prime).
PERIOD = 4093

_random = np.random.default_rng(20240229)
_MOVES = _random.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_MOVES[:, 0] = 0  # what follows a text: nothing is written there
_MULTIPLIERS = _random.integers(1, 1 << 62, SLOTS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_GRAMS = _random.integers(1, 1 << 31, GRAM, dtype=np.int64).astype(np.uint32) | np.uint32(1)


def _codes(text: str) -> np.ndarray:
    """Characters as bytes 1..255: ASCII as it is, others hashed."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, np.maximum(c, 1), (c * np.uint32(2654435761) >> np.uint32(25)) + 128).astype(np.uint8)


class _Positions:
    """Of each slot, the positions at which its hash reaches a new least value: the sample of a walk is what it wrote at
    the last of them, so a walk keeps what it writes at these and forgets the rest."""

    def __init__(self):
        self.known = 0
        self.slots: dict[int, list[int]] = {}  # that have a new least at a position
        self.least = [np.iinfo(np.uint64).max] * SLOTS

    def reach(self, n: int) -> None:
        while self.known < n:
            at = np.arange(self.known, self.known + (1 << 16), dtype=np.uint64)
            for s, m in enumerate(_MULTIPLIERS):
                h = (at + np.uint64(1)) * m
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                low = np.minimum.accumulate(np.r_[np.uint64(self.least[s]), h])
                for position in at[low[1:] < low[:-1]].tolist():
                    self.slots.setdefault(position, []).append(s)
                self.least[s] = low[-1]
            self.known += 1 << 16


_positions = _Positions()


@cache
def _move_lists() -> list[bytes]:
    return [row.tobytes() for row in _MOVES]


def _taken(written: list[np.ndarray]) -> np.ndarray:
    """Bytes 1..255 of the last GRAM written characters, the last one first."""
    h = sum(c.astype(np.uint32) * m for c, m in zip(written, _GRAMS, strict=True))
    return np.maximum((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(24), 1).astype(np.uint8)


def _walk_on(code: bytes, i: int, j: int, before: list[int], held: np.ndarray) -> None:
    """Walks one text from its i-th character and step j to its end; before: what was written last, the latest first;
    held: what the slots keep."""
    moves, n, kept = _move_lists(), len(code), {}
    b, c, d = before
    while i < n:
        _positions.reach(j + PERIOD)
        for row in moves[j % PERIOD :]:
            a = code[i]
            if j in _positions.slots:
                for s in _positions.slots[j]:
                    kept[s] = (a, b, c, d)
            i += row[a]
            j += 1
            b, c, d = a, b, c
            if i >= n:
                break
    if kept:
        held[list(kept)] = _taken(list(np.array(list(kept.values()), np.uint8).T))


def _walk_lanes(codes: list[np.ndarray]) -> np.ndarray:
    """Texts by slots: what the slots keep. Texts are walked side by side, the last few one by one."""
    held = np.zeros((len(codes), SLOTS), np.uint8)
    end = np.zeros(1, np.uint8)
    flat = np.concatenate([x for c in codes for x in (c, end)])
    start = np.r_[0, np.cumsum([len(c) + 1 for c in codes])[:-1]].astype(np.int64)
    lane, at, j = np.arange(len(codes)), start.copy(), 0
    before = [np.zeros(len(codes), np.uint8)] * (GRAM - 1)
    while len(lane) > FEW:
        _positions.reach(j + STRIDE)
        for _ in range(STRIDE):
            c = flat[at]
            if j in _positions.slots:
                live = np.flatnonzero(c)
                held[lane[live][:, None], _positions.slots[j]] = _taken([x[live] for x in (c, *before)])[:, None]
            at += _MOVES[j % PERIOD][c]
            before = [c, *before[:-1]]
            j += 1
        live = np.flatnonzero(flat[at])
        if len(live) < len(lane):
            lane, at, before = lane[live], at[live], [x[live] for x in before]
    for n, (k, i) in enumerate(zip(lane.tolist(), at.tolist(), strict=True)):
        _walk_on(codes[k].tobytes(), i - int(start[k]), j, [int(x[n]) for x in before], held[k])
    return held


def _slots(texts: list[str]) -> np.ndarray:
    """Texts by slots."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    codes = [_codes(t) for t in texts]
    filled = sorted((i for i, c in enumerate(codes) if len(c)), key=lambda i: -len(codes[i]))
    for at in range(0, len(filled), LANES):
        own = filled[at : at + LANES]
        out[own] = _walk_lanes([codes[i] for i in own])
    return out


def fingerprint(column: Column) -> Column:
    """Lower-case hexadecimal, two digits a slot."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            slots = _slots(texts.fillna("").tolist())
            yield pd.Series([row.tobytes().hex() for row in slots], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(column)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints that share a band; 0 for others."""
    at = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    equal = F.size(F.filter(at, lambda i: F.substring(a, i * 2 + 1, 2) == F.substring(b, i * 2 + 1, 2)))
    banded = F.exists(
        F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)),
        lambda i: F.substring(a, i * 2 * BAND + 1, F.lit(2 * BAND)) == F.substring(b, i * 2 * BAND + 1, F.lit(2 * BAND)),
    )
    return F.when(banded, equal / F.lit(float(SLOTS))).otherwise(0.0)


def _links(equal: int):
    """Rows (value, left, right, node, slots) to a spanning forest of the links of `equal` slots or more in each group."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, own in rows.groupby(["value", "left", "right"], sort=False):
            node = own["node"].to_numpy()
            a, b = _forest(np.frombuffer(b"".join(own["slots"]), np.uint8).reshape(-1, SLOTS), equal)
            u.append(node[a])
            v.append(node[b])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    return _by_group(["value", "left", "right"], links)


def group_fingerprints(rows: DataFrame, least: float, id_col: str, band: int = 16) -> DataFrame:
    """(fingerprint, group_id) of rows (id_col, fingerprint): fingerprints linked by a likeness of `least` (above 0) or
    more, all such links; the group is named by its least identifier.

    Bands have `band` slots at most, and no more than let two fingerprints of that likeness differ in every band; bands
    of BAND slots find whatever has a likeness. Equal fingerprints are one row; all that share a band are compared,
    block by block, and the links that hold are thinned to a spanning forest, so that they grow with the rows.
    """
    equal = max(1, math.ceil(least * SLOTS - 1e-9))
    band = max(BAND, min(band, SLOTS // (SLOTS - equal + 1)))
    firsts = rows.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"))
    firsts = materialise(firsts.select("*", F.unhex(F.md5("fingerprint")).alias("node"), F.unhex("fingerprint").alias("slots")), "firsts")
    values = (F.xxhash64(F.lit(s), F.substring("slots", s + 1, band)) for s in range(0, SLOTS, band))
    bands = firsts.select("node", F.explode(F.array(*values)).alias("value"))
    shared = materialise(bands.groupBy("value").count().where("count > 1"), "shared")
    dealt = _blocks(bands, shared, "value", BLOCK).join(firsts.select("node", "slots"), "node").select("value", "left", "right", "node", "slots")
    dealt = dealt.repartition("value", "left", "right").sortWithinPartitions("value", "left", "right")
    roots = components(dealt.mapInPandas(_links(equal), "u binary, v binary"))
    grouped = firsts.select("node", "first_id", "fingerprint").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("group_id")), "root").select("fingerprint", "group_id")


def near_groups(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", band: int = 16) -> DataFrame:
    """(id, fingerprint, group_id): documents linked by a likeness of `least` (above 0) or more, all such links."""
    rows = materialise(docs.select(F.col(id_col), fingerprint(text_or_empty(text_col)).alias("fingerprint")), "fingerprints")
    return rows.join(group_fingerprints(rows, least, id_col, band), "fingerprint").select(id_col, "fingerprint", "group_id")


def _heads(rows: DataFrame, ranges: int) -> tuple[list[str], str]:
    """The first place of each of at most `ranges` even ranges of the order of `with_next`, as JSON, and their type. Spark
    deals the places, which are written so that they are dealt once; one row a range goes through the driver."""
    at = F.struct(F.col("id").isNotNull().alias("named"), "id", FILE, ROW)
    dealt = rows.select(at.alias("at")).repartitionByRange(ranges, "at").select("at", F.spark_partition_id().alias("range"))
    heads = materialise(dealt, "places").groupBy("range").agg(F.min("at").alias("head")).orderBy("head")
    return [r["head"] for r in heads.select(F.to_json("head", {"ignoreNullFields": "false"}).alias("head")).collect()], heads.schema["head"].dataType.simpleString()


def with_next(rows: DataFrame, columns: tuple[str, ...], ranges: int) -> DataFrame:
    """Each of `columns` of the next row by `id`, null first, then by place, as next_<column>; the first row follows the last.

    Rows are dealt to ranges of that order, the first row of each range also to the range before it; so a window over a
    range sees every next row, and no task sees more than its range, however many rows share an identifier.
    """
    heads, kind = _heads(rows, ranges)
    if not heads:
        return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns)).drop(FILE, ROW)
    step = math.isqrt(len(heads) - 1) + 1
    known = lambda some: F.from_json(F.lit(f"[{','.join(some)}]"), f"array<{kind}>")
    every, coarse = known(heads), known(heads[::step])
    own = F.struct(F.col("id").isNotNull().alias("named"), "id", FILE, ROW)
    upto = lambda held: F.size(F.filter(held, lambda h: h <= F.col("own")))
    dealt = rows.withColumn("own", own).withColumn("group", upto(coarse) - 1)
    dealt = dealt.withColumn("range", F.col("group") * step + upto(F.slice(every, F.col("group") * step + 1, F.lit(step))) - 1)
    at = lambda r, guest: F.struct(r.alias("at"), F.lit(guest).alias("guest"))
    first = F.get(every, F.col("range")) == F.col("own")
    to = F.array(at(F.col("range"), False), F.when(first, at(F.pmod(F.col("range") - 1, F.lit(len(heads))), True)))
    copies = dealt.select("id", "own", *columns, F.explode(F.filter(to, lambda t: t.isNotNull())).alias("t"))
    ordered = Window.partitionBy("t.at").orderBy("t.guest", "own")
    nexts = copies.select("*", *(F.lead(c).over(ordered).alias(f"next_{c}") for c in columns), F.col("t.guest").alias("guest"))
    return nexts.where("not guest").drop("t", "guest", "own")


def edited_fingerprints(docs: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id): each text
    against the text whose last quarter is replaced by the start of the next document, and against the next document;
    and the group of documents that a search by bands links to it."""
    rows = placed(docs, F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.select(FILE, ROW, "id", "body", fingerprint(F.col("body")).alias("fingerprint"))
    pairs = with_next(rows, ("body", "fingerprint"), ranges)
    n = F.char_length("body")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), n - cut), F.substring("next_body", F.lit(1), cut))
    pairs = pairs.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    pairs = pairs.select("id", "n_chars", "edited", "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    told = pairs.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
    told = materialise(told, "told")
    return told.join(group_fingerprints(told.select(id_col, "fingerprint"), least, id_col), "fingerprint").select(*told.columns, "group_id")
