"""Sparse rows as linear keys and values, and batches of them as coordinate lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.schema import default_strides

from .position import POS
from .rows import with_batch


def _along(key: Column, stride: int, n: int) -> Column:
    stride, n = F.lit(int(stride)).cast("long"), F.lit(int(n)).cast("long")
    return F.call_function("div", key, stride) % n


def coordinates(key: Column, shape: Sequence[int]) -> Column:
    """The coordinates of a linear row-major key: one number for each dimension."""
    return F.array(*(_along(key, stride, n) for stride, n in zip(default_strides(shape), shape, strict=True)))


def coo_batches(df: DataFrame, column: str, shape: Sequence[int], size: int, pos: str = POS) -> DataFrame:
    """One row per batch: batch_id, shape (rows first), data, and coords, an array for each dimension.

    column: struct of keys and values. Rows are in order of pos; a null cell adds no entries. A batch is size rows.
    """
    row = F.struct((F.col(pos) % size).alias("row"), F.col(f"{column}.keys").alias("keys"), F.col(f"{column}.values").alias("values"))
    held = with_batch(df, size, pos).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    of = lambda value: F.flatten(F.transform("rows", value))
    keys = lambda r: F.coalesce(r["keys"], F.array().cast("array<bigint>"))
    axis = lambda stride, n: of(lambda r: F.transform(keys(r), lambda k: _along(k, stride, n)))
    dims = [axis(stride, n) for stride, n in zip(default_strides(shape), shape, strict=True)]
    rows = of(lambda r: F.transform(keys(r), lambda k: r["row"]))
    kind = df.select(f"{column}.values").schema[0].dataType
    data = of(lambda r: F.coalesce(r["values"], F.array().cast(kind)))
    return held.select("batch_id", F.array(F.col("n"), *(F.lit(int(n)).cast("long") for n in shape)).alias("shape"), data.alias("data"), F.array(rows, *dims).alias("coords"))


def to_csr(data: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) of a matrix in coordinate form."""
    order = np.lexsort((columns, rows))
    counts = np.bincount(np.asarray(rows, np.int64), minlength=n_rows)
    return np.asarray(data)[order], np.asarray(columns, np.int64)[order], np.r_[0, np.cumsum(counts)]
