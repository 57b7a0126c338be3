"""SimHash near-dedup by anchor-point covering.

Fingerprint: one or more words of 64 bits over word shingles; a bit is set where more than half of the shingle hashes
have it. The first word is over XXH64 with seed 42; further words mix the same hashes anew.

Search: windows of the fingerprint have anchors, the words of a Hamming code over their first 2^r - 1 bits: a covering
code of radius 1. A fingerprint lives at the one anchor within radius 1 (its home) and is replicated to every anchor
within radius plus threshold, so of two fingerprints that differ in one bit of a window or none, one meets the other
at its home. At each anchor all fingerprints are compared in full, and the links found are thinned to a least spanning
forest, so that a group of copies adds rows in proportion to its size. Anchors with many fingerprints are compared
block by block, each pair of blocks by itself.

- `exact_groups`: all links within 3 bits of 64, by two windows of 32 bits (of 3 differing bits one window has one at
  most), the bits beyond the code's 31 being flipped as well.
- `similar_groups`: links of likeness `least` or more: the exact Jaccard likeness of the sets of shingles, of which the
  texts of a pair are asked. Pairs that SimHash tells apart badly (short texts, repeated lines) decide here, so what
  meets is not its windows but bands of least hashes: BANDS bands of ROWS least hashes of the set, which a pair of
  likeness 0.8 shares in all but 7 of a million cases. Where texts meet, a sketch, a byte of each hash, puts aside
  pairs 4.5 deviations below `least`, and the others make groups of candidates. Within a group all texts are
  compared in full and only links that hold are thinned: see `_verified_links`.
- `near_groups`: the links of both, in one search for components.

Before the search, `exact_groups` merges equal fingerprints, `similar_groups` equal sets of shingles (by a 64-bit
digest). Null and empty texts have fingerprint zero and link like any other (in `similar_groups` to each other only).
Repeated rows are grouped each; an empty table gives no rows; further columns are ignored. Identifiers are of any type
that has an order; rows without one are grouped like others and name a group only where no member has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, text_or_empty

SEED = 42
#: Fingerprints of one anchor that are compared in one task, at most twice so many.
ANCHOR_BLOCK = 2048
#: Up to so many crowded anchors (12 bytes each) are broadcast.
BROADCAST_CROWDED = 100_000
#: Groups of up to so many rows are compared side by side.
SMALL = 24
#: Bands of least hashes, and the hashes of a band; a byte of each is the sketch.
BANDS, ROWS = 30, 5
SKETCH = BANDS * ROWS
#: Deviations below the limit at which a pair is put aside unseen.
DEVIATIONS = 4.5
#: Up to so many anchors that more than one set has (12 bytes each) are broadcast.
BROADCAST_SHARED = 1_000_000
#: Sets that meet at a band are compared in blocks of so many.
BAND_BLOCK = 1024
#: Texts of a group of candidates are compared in blocks of so many.
TEXT_BLOCK = 512
#: Texts of up to so many candidates (16 bytes each) are fetched by a broadcast.
BROADCAST_NODES = 200_000

_random = np.random.default_rng(20240301)
_ODD = _random.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """Of each shingle its hash, in order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def simhash_words(text: str | None, shingle: int = 3, n_words: int = 1) -> np.ndarray:
    """Unsigned 64-bit words of the fingerprint of one text."""
    return _simhash_of(shingle_hashes(text, shingle), n_words)


def _simhash_of(hashes: np.ndarray, n_words: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(n_words, np.uint64)
    ones = np.zeros((n_words, 64), np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        for k in range(n_words):
            bits = np.unpackbits(_mixed(part, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def simhash(text: str | None, shingle: int = 3) -> int:
    return int(simhash_words(text, shingle)[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for word 0, other hashes made of them for the words after it."""
    if k == 0:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59B)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprint(column: Column, shingle: int = 3, n_words: int = 1) -> Column:
    """Array of n_words signed longs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash_words(t, shingle, n_words).view(np.int64) for t in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<long>")(column)


@dataclass(frozen=True)
class Window:
    """Bits low to low + width of a word of the fingerprint; the first 2^r - 1 of them are coded. The rest agree, or
    may differ in one bit where the coded ones do not if flip_rest."""

    word: int
    low: int
    width: int
    coded: int
    flip_rest: bool


#: Windows of the first word at which all pairs within 3 bits meet.
WITHIN_3 = [Window(0, low, 32, 31, True) for low in (0, 32)]


def anchors_of(words: np.ndarray, window: Window) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor): the home of each, and every other anchor within 2 bits."""
    one, bits = np.uint64(1), (words[:, window.word] >> np.uint64(window.low)) & np.uint64((1 << window.width) - 1)
    syndrome = np.zeros(len(bits), np.int64)
    for j in range(window.coded.bit_length()):
        mask = sum(1 << (i - 1) for i in range(1, window.coded + 1) if i >> j & 1)
        syndrome |= (np.bitwise_count(bits & np.uint64(mask)) & 1).astype(np.int64) << j
    flip = np.r_[np.uint64(0), one << np.arange(window.coded, dtype=np.uint64)]  # of each position, counted from 1
    home = bits ^ flip[syndrome]
    at, anchor = [np.arange(len(bits))], [home]
    for i in range(1, window.coded + 1):
        other = i ^ syndrome
        own = np.flatnonzero((syndrome != 0) & (i < other) & (i != syndrome))
        at.append(own)
        anchor.append(bits[own] ^ flip[i] ^ flip[other[own]])
    for i in range(window.coded, window.width) if window.flip_rest else ():
        at.append(at[0])
        anchor.append(home ^ (one << np.uint64(i)))
    return np.concatenate(at), np.concatenate(anchor)


def _spread(windows: list[Window]):
    """Rows (node, words) to rows (anchor, node, fp), one for each anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                words, node = np.stack(part["words"].to_numpy()).view(np.uint64), part["node"].to_numpy()
                fp = words[:, 0].view(np.int64)
                for w, window in enumerate(windows):
                    at, anchor = anchors_of(words, window)
                    yield pd.DataFrame({"anchor": anchor.astype(np.int64) + (w << 40), "node": node[at], "fp": fp[at]})

    return run


def _spanning(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a least spanning forest over distances up to most: two arrays of places, and the distances (Prim)."""
    n = len(fps)
    near, by = np.full(n, 255, np.uint8), np.zeros(n, np.int64)
    out_of, a, b, d = np.ones(n, bool), [], [], []
    at = 0
    for _ in range(n - 1):
        out_of[at] = False
        near[at] = 255
        gap = np.bitwise_count(fps[at] ^ fps)
        closer = out_of & (gap < near)
        near[closer], by[closer] = gap[closer], at
        at = int(near.argmin())
        if near[at] == 255:
            at = int(out_of.argmax())
        if near[at] <= most:
            a.append(int(by[at]))
            b.append(at)
            d.append(int(near[at]))
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d, np.int64)


def _thinned(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> list[int]:
    """Places of the links of a least spanning forest among links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    kept = []
    for i in np.argsort(d, kind="stable").tolist():
        a, b = find(int(u[i])), find(int(v[i]))
        if a != b:
            root[a] = b
            kept.append(i)
    return kept


def _compare(most: int):
    """Sorted rows (anchor, left, right, node, fp) of a partition to links; groups of many rows are held one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None or held.empty else pd.concat([held, batch])
            k = held[["anchor", "left", "right"]].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if len(new):
                yield links(held.iloc[: new[-1]])
                held = held.iloc[new[-1] :]
        if held is not None and len(held):
            yield links(held)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows[["anchor", "left", "right"]].to_numpy()
        node, fp = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        start = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        size = np.diff(np.r_[start, len(k)])
        group = np.repeat(np.arange(len(start)), size)
        small = np.flatnonzero(np.repeat(size <= SMALL, size))
        found = []
        for step in range(1, int(min(SMALL, size.max()))):
            a = small[small + step < len(group)]
            a = a[group[a] == group[a + step]]
            gap = np.bitwise_count(fp[a] ^ fp[a + step])
            hit = gap <= most
            found.append((node[a[hit]], node[a[hit] + step], gap[hit]))
        for g in np.flatnonzero(size > SMALL):
            own = slice(start[g], start[g] + size[g])
            a, b, gap = _spanning(fp[own], most)
            found.append((node[own][a], node[own][b], gap))
        u, v, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (node[:0], node[:0], node[:0])
        kept = _thinned(u, v, d)
        return pd.DataFrame({"u": u[kept], "v": v[kept]})

    return run


def links(firsts: DataFrame, windows: list[Window], most: int) -> DataFrame:
    """firsts (node, words) to links (u, v) of nodes whose first words are within `most` bits and that meet at an
    anchor; thinned, with the components of all such pairs."""
    at = firsts.select("node", "words").mapInPandas(_spread(windows), "anchor long, node long, fp long")
    crowded = at.groupBy("anchor").count().where(F.col("count") > ANCHOR_BLOCK)
    crowded = materialise(crowded.select("anchor", F.ceil(F.col("count") / ANCHOR_BLOCK).cast("int").alias("parts")), "crowded")
    if crowded.count() <= BROADCAST_CROWDED:
        crowded = F.broadcast(crowded)
    met = at.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("node", "anchor"), F.col("parts")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "anchor", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "node", "fp"
    )
    spread = dealt.repartition("anchor", "left", "right").sortWithinPartitions("anchor", "left", "right")
    return spread.mapInPandas(_compare(most), "u long, v long")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_words: int) -> DataFrame:
    words = fingerprint(text_or_empty(text_col), shingle, n_words)
    return materialise(docs.select(F.col(id_col).alias("id"), words.alias("words")), "fingerprints")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id_col, fp (signed), component_id, the least identifier that links of 3 bits or fewer reach."""
    rows = _fingerprints(docs, id_col, text_col, shingle, 1).select("id", F.col("words")[0].alias("fp"))
    firsts = materialise(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "firsts")
    nodes = firsts.select(F.col("fp").alias("node"), F.array("fp").alias("words"))
    roots = components(links(nodes, WITHIN_3, 3)).withColumnRenamed("node", "fp")
    return _named(rows, firsts, roots, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _named(rows: DataFrame, firsts: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """rows with component_id: of all firsts (key, first_id) of a root (key, root) the least identifier."""
    grouped = firsts.select(key, "first_id").join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select(key, "component_id")
    return rows.join(named, key)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS hashes: of each of so many orders of the set the first."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (low[at : at + 2048] * _ODD[0] + high[at : at + 2048] * _ODD[1]).min(axis=1), out=least)
    return least


def _signatures(column: Column, shingle: int, fp_shingle: int) -> Column:
    """fp (over shingles of fp_shingle words), node and other (digests of the set of shingles), anchors (of the bands), sketch;
    no anchors for a text without words."""
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                hashes = shingle_hashes(text, shingle)
                fp = _simhash_of(hashes if fp_shingle == shingle else shingle_hashes(text, fp_shingle), 1).view(np.int64)[0]
                hashes = np.unique(hashes)
                least = least_hashes(hashes)
                bands = [digest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))] if len(hashes) else []
                node = np.uint64(digest(hashes.tobytes(), SEED)).view(np.int64)
                other = np.uint64(digest(hashes.tobytes(), SEED + 1)).view(np.int64)
                rows.append((fp, node, other, np.array(bands, np.uint64).view(np.int64), least.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["fp", "node", "other", "anchors", "sketch"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "fp long, node long, other long, anchors array<long>, sketch binary")(column)


def _forest(sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a likest spanning forest over pairs of `least` equal bytes or more (Prim)."""
    n = len(sketch)
    near, by = np.full(n, -1), np.zeros(n, np.int64)
    out_of, a, b = np.ones(n, bool), [], []
    at = 0
    for _ in range(n - 1):
        out_of[at] = False
        near[at] = -1
        like = np.count_nonzero(sketch == sketch[at], axis=1)
        closer = out_of & (like > near)
        near[closer], by[closer] = like[closer], at
        at = int(near.argmax())
        if near[at] >= least:
            a.append(int(by[at]))
            b.append(at)
    return np.array(a, np.int64), np.array(b, np.int64)


def _by_group(keys: list[str], of_groups):
    """Sorted rows of a partition to what of_groups makes of whole groups; groups of many rows are held one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None or held.empty else pd.concat([held, batch])
            k = held[keys].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if len(new):
                yield of_groups(held.iloc[: new[-1]])
                held = held.iloc[new[-1] :]
        if held is not None and len(held):
            yield of_groups(held)

    return run


def _propose(least: int):
    """Rows (anchor, left, right, node, sketch) to links that have the components of all pairs that meet and whose
    sketches agree in `least` bytes or more."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows[["anchor", "left", "right"]].to_numpy()
        node = rows["node"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH)
        start = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        size = np.diff(np.r_[start, len(k)])
        group = np.repeat(np.arange(len(start)), size)
        small = np.flatnonzero(np.repeat(size <= SMALL, size))
        found = [(node[:0], node[:0])]
        near = []
        for step in range(1, int(min(SMALL, size.max()))):
            a = small[small + step < len(group)]
            a = a[group[a] == group[a + step]]
            like = np.count_nonzero(sketch[a] == sketch[a + step], axis=1)
            near.append((a[like >= least], a[like >= least] + step, like[like >= least]))
        if near:
            a, b, like = (np.concatenate(x) for x in zip(*near, strict=True))
            kept = _thinned(node[a], node[b], -like)
            found.append((node[a[kept]], node[b[kept]]))
        for g in np.flatnonzero(size > SMALL):
            own = slice(start[g], start[g] + size[g])
            a, b = _forest(sketch[own], least)
            found.append((node[own][a], node[own][b]))
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return _by_group(["anchor", "left", "right"], links)


def exact_links(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over all pairs of sets (not empty) of Jaccard likeness `least` or more."""
    size = np.array([len(x) for x in sets])
    kinds, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(size)[:-1])
    left, waiting, a, b = np.arange(len(sets)), [], [], []
    flat, start = code, np.r_[0, np.cumsum(size)[:-1]]
    while len(left):
        at = waiting.pop() if waiting else int(left[0])
        if at == left[0] or at in left:
            left = left[left != at]
            if not len(left):
                break
            flat = np.concatenate([codes[i] for i in left])
            start = np.r_[0, np.cumsum(size[left])[:-1]]
        own = np.zeros(len(kinds), bool)
        own[codes[at]] = True
        both = np.add.reduceat(own[flat], start, dtype=np.int64)
        hit = both >= least * (size[left] + size[at] - both) - 1e-9
        if hit.any():
            to = left[hit].tolist()
            a += [at] * len(to)
            b += to
            waiting += to
            left = left[~hit]
            if len(left):
                flat = np.concatenate([codes[i] for i in left])
                start = np.r_[0, np.cumsum(size[left])[:-1]]
    return a, b


def _verify(shingle: int, least: float):
    """Rows (root, left, right, node, body) to links of the exact likeness of the texts."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, own in rows.groupby(["root", "left", "right"], sort=False):
            node = own["node"].to_numpy()
            a, b = exact_links([np.unique(shingle_hashes(t, shingle)) for t in own["body"]], least)
            u.append(node[a])
            v.append(node[b])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    return _by_group(["root", "left", "right"], links)


def _blocks(rows: DataFrame, sized: DataFrame, key: str, block: int) -> DataFrame:
    """rows (key, node, ...) of the keys of `sized` (key, count) in pairs of blocks, each pair by itself: left, right."""
    met = rows.join(sized, key).withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node", key), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other")).drop("parts", "count", "part", "other")


def _verified_links(firsts: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """(u, v): links of likeness `least` or more by the texts.

    Pairs that meet at a band and whose sketches do not rule them out make groups of candidates. Within a group all
    pairs of texts are compared in full, block by block, and the links that hold are thinned to a spanning forest.
    """
    share = least + (1 - least) / 256
    loose = math.floor(SKETCH * share - DEVIATIONS * math.sqrt(SKETCH * share * (1 - share)))
    at = firsts.select(F.explode("anchors").alias("anchor"), "node")
    shared = materialise(at.groupBy("anchor").count().where("count > 1"), "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_SHARED else shared
    met = _blocks(at, shared, "anchor", BAND_BLOCK).join(firsts.select("node", "sketch"), "node")
    met = met.select("anchor", "left", "right", "node", "sketch").repartition("anchor", "left", "right").sortWithinPartitions("anchor", "left", "right")
    roots = materialise(components(met.mapInPandas(_propose(loose), "u long, v long")), "candidates")
    few = roots.count() <= BROADCAST_NODES
    bodies = rows.select("node", "body").join(F.broadcast(roots) if few else roots, "node").groupBy("node", "root").agg(F.min("body").alias("body"))
    sized = roots.groupBy("root").count()
    dealt = _blocks(bodies, F.broadcast(sized) if few else sized, "root", TEXT_BLOCK).select("root", "left", "right", "node", "body")
    dealt = dealt.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right")
    return dealt.mapInPandas(_verify(shingle, least), "u long, v long")


def _firsts(rows: DataFrame) -> DataFrame:
    """A row a node; `clash` where sets that share it differ in their other digest."""
    own = (F.min("id").alias("first_id"), F.first("anchors").alias("anchors"), F.first("sketch").alias("sketch"))
    return materialise(rows.groupBy("node").agg(*own, (F.min("other") != F.max("other")).alias("clash")), "firsts")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8
) -> DataFrame:
    """One row per input row: id_col, fp, component_id, linked by shingle likeness of `least` or more."""
    rows, firsts = _sets(docs, id_col, text_col, shingle, shingle)
    roots = components(_verified_links(firsts, rows, shingle, least))
    return _named(rows.select("id", "fp", "node"), firsts, roots, "node").select(F.col("id").alias(id_col), "fp", "component_id")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, like: int = 5, least: float = 0.8
) -> DataFrame:
    """One row per input row: id_col, fp (over shingles of `shingle` words), component_id, linked where fingerprints differ
    in 3 bits or fewer, as in `exact_groups`, and by likeness of shingles of `like` words, as in `similar_groups`."""
    rows, firsts = _sets(docs, id_col, text_col, like, shingle)
    roots = components(_fingerprint_links(rows).unionByName(_verified_links(firsts, rows, like, least)))
    return _named(rows.select("id", "fp", "node"), firsts, roots, "node").select(F.col("id").alias(id_col), "fp", "component_id")


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, fp_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, body and signatures of each row; a row a node, none of which stands for two sets)."""
    said = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    said = said.select("id", "body", _signatures(F.col("body"), shingle, fp_shingle).alias("s")).select("id", "body", "s.*")
    rows = materialise(said, "signatures", compression="zstd")
    firsts = _firsts(rows)
    while not (clashes := firsts.where("clash").select("node")).isEmpty():  # sets apart by 128 bits that share a node
        rows = rows.join(clashes.withColumn("clash", F.lit(True)), "node", "left")
        rows = rows.withColumn("node", F.when(F.col("clash"), F.xxhash64("other", "node")).otherwise(F.col("node"))).drop("clash")
        rows = materialise(rows, "signatures", compression="zstd")
        firsts = _firsts(rows)
    return rows, firsts


def _fingerprint_links(rows: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints differ in 3 bits or fewer, through the least node of each fingerprint."""
    of = materialise(rows.groupBy("fp", "node").agg(F.lit(1).alias("one")).drop("one"), "fingerprints")
    firsts = materialise(of.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    shared = firsts.where("n > 1").select("fp", "first")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_SHARED else shared
    same = of.join(shared, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = links(firsts.select(F.col("fp").alias("node"), F.array("fp").alias("words")), WITHIN_3, 3)
    end = lambda name, place: firsts.select(F.col("fp").alias(name), F.col("first").alias(place))
    return same.unionByName(near.join(end("u", "a"), "u").join(end("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
