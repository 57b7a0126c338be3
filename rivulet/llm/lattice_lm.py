"""Subword lattice likelihood.

Words are scored by a unigram model over the pieces of an existing vocabulary: the log-space forward recursion over a
word's lattice sums the probability of all its segmentations. Piece weights start from the vocabulary's scores (ranks,
taken as Zipf's law) and are re-estimated from the training texts in a few steps: the forward-backward expectation of
every piece over all training words and their counts, with the start as a prior. Characters outside the vocabulary cost
their bytes. A text is its lower-cased words, each begun with a space mark, then an end; the end is a piece of its
own.

The base score beside it is an add-0.1 unigram over whole words.

Execution: a pass over the texts numbers the words of each block of texts and keeps each text as word numbers. Block
vocabularies (words with their training counts) are summed over the corpus, scored once per distinct word, joined back
to the blocks and met there by the texts. A frequent word is one row in a block, never one in an occurrence; nothing
that grows with the corpus goes through the driver.

Null text counts as empty: one end. Repeated rows are scored each; a null identifier stays null; an empty table gives
no rows. Without training texts base and score are those of
the priors.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty

SPACE = "▁"
#: Bytes of text, and texts, that share a block vocabulary.
BLOCK_BYTES, BLOCK_TEXTS = 16 << 20, 8192
#: Blocks dealt to a task, which meets them one after the other.
TASK_BLOCKS = 16
#: Zipf offset, and the weight of the prior in pieces.
OFFSET, PRIOR = 10.0, 5000.0
#: Lattice cells held at a time.
CELLS = 1 << 19


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Pieces in a hash table of trie edges, for many words at a time."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = [model.id_to_piece(i) for i in ids]
        rank = np.argsort(np.argsort([-model.get_score(i) for i in ids], kind="stable"), kind="stable") + 1.0
        self.end, self.byte = len(ids), len(ids) + 1  # pseudo-pieces after the pieces
        weight = 1 / (rank + OFFSET)
        # the end is taken to be one in a hundred pieces, bytes of other characters one in a thousand
        self.prior = np.r_[weight / weight.sum() * (1 - 0.011), 0.01, 0.001]
        edges, nodes, accept = {}, 1, {}
        for piece, text in enumerate(self.pieces):
            node = 0
            for ch in map(ord, text):
                key = node << 21 | ch
                node = edges.get(key)
                if node is None:
                    node = edges[key] = nodes
                    nodes += 1
            accept[node] = piece
        self.accept = np.full(nodes, -1, np.int64)
        self.accept[list(accept)] = list(accept.values())
        keys, values = np.array(list(edges), np.uint64), np.array(list(edges.values()), np.int64)
        self.mask = np.uint64((1 << (2 * len(keys)).bit_length()) - 1)
        self.keys, self.next = np.full(int(self.mask) + 1, np.iinfo(np.uint64).max), np.zeros(int(self.mask) + 1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # open addressing, all keys a round
            free = self.keys[slot[left]] == np.iinfo(np.uint64).max
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.next[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        self.longest = max(map(len, self.pieces))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ h >> np.uint64(29)) & self.mask

    def _follow(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The next trie node, -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | ch
        slot, out = self._slot(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (at != np.iinfo(np.uint64).max)]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
        return out

    def _edges(self, code: np.ndarray, length: np.ndarray, s: int, size: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(words, characters, piece, times) of the edges from position s; a character without a piece gives its bytes."""
        lane = np.flatnonzero(length > s)
        node = np.zeros(len(lane), np.int64)
        for k in range(1, self.longest + 1):
            within = length[lane] >= s + k
            lane, node = lane[within], node[within]
            if not len(lane):
                return
            node = self._follow(node, code[lane, s + k - 1])
            alive = node >= 0
            piece = np.where(alive, self.accept[node], -1)
            if k == 1 and (piece < 0).any():
                other = lane[piece < 0]
                yield other, 1, np.full(len(other), self.byte), size[other, s]
            lane, node, piece = lane[alive], node[alive], piece[alive]
            if not len(lane):
                return
            if (own := piece >= 0).any():
                yield lane[own], k, piece[own], np.ones(int(own.sum()))

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places in words, code points, lengths, bytes of each character), words of like length together."""
        texts = [(SPACE + w.decode("utf-8", "surrogatepass")) for w in words]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            z = at + 1
            while z < len(order) and (z - at + 1) * len(texts[order[z]]) <= CELLS:
                z += 1
            own = order[at:z]
            length = np.array([len(texts[i]) for i in own])
            code = np.zeros((len(own), length[-1]), np.uint64)
            code[np.arange(length[-1]) < length[:, None]] = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = 1.0 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            yield np.array(own), code, length, size
            at = z

    def forward(self, code, length, size, logp: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Words by positions: natural log of the summed probability of all segmentations up to there. The edges met, as
        (position, words, characters, log probability, piece, times), are added to `edges`."""
        alpha = np.full((len(code), code.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for s in range(code.shape[1]):
            for lane, k, piece, times in self._edges(code, length, s, size):
                cost = times * logp[piece]
                alpha[lane, s + k] = np.logaddexp(alpha[lane, s + k], alpha[lane, s] + cost)
                if edges is not None:
                    edges.append((s, lane, k, cost, piece, times))
        return alpha

    def log10(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for own, code, length, size in self.batches(words):
            out[own] = self.forward(code, length, size, logp)[np.arange(len(own)), length]
        return out / math.log(10)

    def expected(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, each as often as it counts."""
        total = np.zeros(len(logp))
        for own, code, length, size in self.batches(words):
            edges: list = []
            alpha = self.forward(code, length, size, logp, edges)
            z = alpha[np.arange(len(own)), length]
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(own)), length] = 0
            for s, lane, k, cost, piece, times in reversed(edges):
                ahead = cost + beta[lane, s + k]
                beta[lane, s] = np.logaddexp(beta[lane, s], ahead)
                use = np.exp(alpha[lane, s] + ahead - z[lane]) * counts[own[lane]] * times
                total += np.bincount(piece, use, len(total))
        return total


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, body, train) to rows of two kinds: the words of a block, and each text as word numbers."""
    part, block = TaskContext.get().partitionId(), 0
    texts: list[tuple] = []
    number: defaultdict = defaultdict(count().__next__)
    read = 0

    def flush() -> pd.DataFrame:
        train = [w for _, w, t in texts if t]
        n = np.bincount(np.concatenate(train), minlength=len(number)) if train else np.zeros(len(number), np.int64)
        key = part << 24 | block
        words = pd.DataFrame({"block": key, "number": np.arange(len(number), dtype=np.int32), "word": list(number), "n": n.astype(np.int64)})
        bags = pd.DataFrame({"block": key, "id": [i for i, _, _ in texts], "train": [bool(t) for _, _, t in texts], "bag": [w.astype("<i4").tobytes() for _, w, _ in texts]})
        return pd.concat([words, bags]).reindex(columns=["block", "number", "word", "n", "id", "train", "bag"]).astype({"number": "Int32", "n": "Int64", "train": "boolean"}).astype({"word": object, "bag": object}).replace({np.nan: None})

    for batch in batches:
        for key, body, train in zip(batch["id"], batch["body"], batch["train"], strict=True):
            texts.append((key, np.fromiter(map(number.__getitem__, words_of(body)), np.int32), train))
            read += len(body)
            if read >= BLOCK_BYTES or len(texts) >= BLOCK_TEXTS:
                yield flush()
                block, read = block + 1, 0
                texts.clear()
                number = defaultdict(count().__next__)
    if texts:
        yield flush()


def _expecting(vocabulary: str, logp: np.ndarray):
    """Rows of words and counts to the expected uses of the pieces in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(logp))
        for b in batches:
            total += lattice(vocabulary).expected(b["word"].tolist(), b["c"].to_numpy(np.float64), logp)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"piece": at.astype(np.int32), "uses": total[at]})

    return run


def score(docs: DataFrame, train: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, steps: int = 3) -> DataFrame:
    """One row per input row: id_col, train, n_tokens, n_known, train_tokens, base_score, score (log10).

    steps: expectation steps over the distinct training words, each one pass that brings at most a row for each piece
    of the vocabulary to the driver.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("body"), F.coalesce(train, F.lit(False)).alias("train"))
    both = materialise(rows.mapInPandas(_numbered, "block long, number int, word binary, n long, id string, train boolean, bag binary"), "numbered", compression="zstd")
    words = both.where("word is not null").select("block", "number", "word", "n")
    bags = both.where("bag is not null").select("block", "id", "train", "bag")
    ends = bags.where("train").count()
    counted = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    known = counted.where("c > 0").agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = known["n"] + ends, known["v"] + (ends > 0)

    own = lattice(vocabulary)
    logp = np.log(own.prior)
    learnt = counted.where("c > 0")
    for _ in range(steps):
        uses = learnt.mapInPandas(_expecting(vocabulary, logp), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        weight = own.prior * PRIOR
        for r in uses.collect():  # at most one row for each piece of the vocabulary
            weight[r["piece"]] += r["uses"]
        weight[own.end] += ends
        logp = np.log(weight / weight.sum())
    logp[own.byte] -= math.log(256)  # which byte it is
    log_end = logp[own.end] / math.log(10)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "c": b["c"], "lp": lattice(vocabulary).log10(b["word"].tolist(), logp)})

    rated = counted.mapInPandas(rate, "word binary, c long, lp double")
    blocks = bags.select("block").distinct().count()
    parts = max(-(-blocks // TASK_BLOCKS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task holds one block at a time
    met = words.join(rated, "word").select(F.col("block").alias("of"), "number", "c", "lp").repartition(parts, "of")
    below = n + add * (v + 1)
    base_end = math.log10((ends + add) / below)

    def meet(bag: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        c, lp = np.zeros(len(dictionary)), np.zeros(len(dictionary))
        at = dictionary["number"].to_numpy()
        c[at], lp[at] = dictionary["c"], dictionary["lp"]
        base = np.log10((c + add) / below)
        out = []
        for key, train, raw in zip(bag["id"], bag["train"], bag["bag"], strict=True):
            own = np.frombuffer(raw, "<i4")
            out.append((key, train, len(own) + 1, int((c[own] > 0).sum()) + (ends > 0), base[own].sum() + base_end, lp[own].sum() + log_end))
        return pd.DataFrame(out, columns=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    scored = bags.repartition(parts, "block").groupBy("block").cogroup(met.groupBy("of")).applyInPandas(
        meet, "id string, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
