"""Language identification with string kernels.

Kernel: two texts share presence of character n-grams of length 1 to `longest` (a blended spectrum over lower-cased
letters; anything else is a space), hashed into a fixed number of slots: k(x, z) = |x and z| / sqrt(|x| |z|).
Model: Nyström landmarks from a bounded sample of labelled rows and one-versus-rest kernel ridge regression on them.
Scoring: presence rows of a block of texts times the landmark matrix, times the coefficients.

Bounds: at most `per_class` sampled rows of each label and `max_classes` labels; each sampled row is reduced to its
slots (SLOTS bits) where it lies, so that the driver gets a fixed number of bytes. Every text is scored whole.

Null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn from. Rows
without a label are scored, not learnt from. Ties go to the first label in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots that n-grams are hashed into; a power of two.
SLOTS = 1 << 15
UNDETERMINED = "und"
#: Texts scored at a time in a task.
BLOCK = 256
_SHIFT = 32 - (SLOTS - 1).bit_length()
_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def slots_of(text: str, longest: int = 3) -> np.ndarray:
    """Slots of the n-grams of a text, repeats included."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    other = (code < 128) & ((code < 97) | (code > 122))
    code[other] = 32
    if len(code) > 1:
        code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]  # runs of spaces count as one
    out, gram = [], np.zeros(len(code), np.uint32)
    for n in range(min(longest, len(code))):
        gram = (gram[: len(code) - n] * np.uint32(0x01000193)) ^ (code[n:] * _ODD[0])
        out.append((gram * _ODD[n + 1]) >> np.uint32(_SHIFT))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def lettered(column: Column) -> Column:
    """has_letter of each text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([isinstance(t, str) and has_letter(t) for t in texts], dtype=bool)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")(column)


@dataclass
class Model:
    labels: list[str]
    column: np.ndarray  # of each slot, or -1
    landmarks: np.ndarray  # columns by landmarks, each of norm 1
    weights: np.ndarray  # landmarks by labels
    longest: int

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.landmarks) + 1), np.float32)
        for row, text in zip(x, texts, strict=True):
            row[self.column[slots_of(text, self.longest)]] = 1  # the last column takes what has none
        x = x[:, :-1]
        k = x @ self.landmarks
        k /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        return k @ self.weights


def fit(labels: list[str], bits: np.ndarray, landmarks: int = 128, columns: int = 8192, ridge: float = 1e-3, longest: int = 3) -> Model:
    """bits: packed presence rows of the sample."""
    names = sorted(set(labels))
    x = np.unpackbits(bits, axis=1, bitorder="little")
    seen = x.sum(axis=0).astype(np.int64)
    chosen = np.sort(np.argsort(-seen, kind="stable")[: min(columns, int((seen > 0).sum()))])
    column = np.full(SLOTS, len(chosen), np.int64)
    column[chosen] = np.arange(len(chosen))
    x = x[:, chosen].astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    y = np.array([[1.0 if own == n else -1.0 for n in names] for own in labels])
    each = {n: np.flatnonzero(y[:, i] > 0)[: max(1, landmarks // len(names))] for i, n in enumerate(names)}
    z = x[np.sort(np.concatenate(list(each.values())))]
    k_nm, k_mm = (x @ z.T).astype(np.float64), (z @ z.T).astype(np.float64)
    weight = 1 / np.maximum((y > 0).sum(axis=0), 1) @ (y > 0).T  # labels count alike however many rows they have
    left = k_nm.T @ (weight[:, None] * k_nm) + ridge * k_mm + 1e-8 * np.eye(len(z))
    w = np.linalg.solve(left, k_nm.T @ (weight[:, None] * y))
    return Model(names, column, np.ascontiguousarray(z.T), w.astype(np.float32), longest)


def sample(labelled: DataFrame, per_class: int, max_classes: int, longest: int, seed: int) -> tuple[list[str], np.ndarray]:
    """At most per_class rows (id, body, label) of each label, as packed presence rows; cut in Spark, so that no more
    come to the driver. The draw is by identifier and text, so rows that share an identifier are drawn one by one."""
    counts = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} labels")
    if not counts:
        return [], np.zeros((0, SLOTS // 8), np.uint8)
    order = F.xxhash64(F.lit(seed), "id", "body")
    rate = F.create_map(*(F.lit(v) for r in counts for v in (r["label"], min(1.0, 1.3 * per_class / r["count"]))))
    part = labelled.where((order / F.lit(2.0**64) + 0.5) < F.element_at(rate, F.col("label"))).select("label", "body", order.alias("place"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = []
            for text in b["body"]:
                row = np.zeros(SLOTS, np.uint8)
                row[slots_of(text, longest)] = 1
                bits.append(np.packbits(row, bitorder="little").tobytes())
            yield pd.DataFrame({"label": b["label"], "place": b["place"], "bits": bits})

    drawn = part.mapInPandas(reduce, "label string, place long, bits binary")
    place = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    kept = sorted((r["label"], r["place"], bytes(r["bits"])) for r in drawn.withColumn("n", place).where(F.col("n") <= per_class).collect())
    return [label for label, _, _ in kept], np.array([np.frombuffer(bits, np.uint8) for _, _, bits in kept]).reshape(-1, SLOTS // 8)


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    per_class: int = 512, max_classes: int = 64, landmarks: int = 128, longest: int = 3, seed: int = 11,
) -> Model | None:
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(label_col).alias("label"))
    labels, bits = sample(rows, per_class, max_classes, longest, seed)
    return fit(labels, bits, landmarks, longest=longest) if labels else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added; columns of those names in docs are replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch]
            label, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            for at in range(0, len(able), BLOCK):
                own = able[at : at + BLOCK]
                f = model.score([texts[i] for i in own])
                top = f.argmax(axis=1)
                for i, best, value in zip(own, top, f.max(axis=1), strict=True):
                    label[i] = model.labels[best]
                    score[i] = min(1.0, max(0.0, (float(value) + 1) / 2))
            yield pd.DataFrame({"lang_pred": label, "score": score})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()  # else a filter on it scores each text twice
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, udf(F.col(text_col)).alias("__said")).select(*kept, "__said.lang_pred", "__said.score")
