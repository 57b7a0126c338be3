"""Nearest neighbours by cosine: a block matrix join of int8 products with error bounds.

Queries and candidates are dealt to blocks; a tile is one block of each. In a tile vectors are scaled to length one and
quantised to int8 with a scale of their own; the product of two quantised blocks gives each cosine within a bound that
follows from the lengths of the two rounding errors. Pairs whose upper bound is below the k-th best so far, or below the
k-th largest lower bound beside it, fall out. The pairs that survive are recomputed from the original vectors in double
precision and go to a heap a query; the heaps of the tiles are merged by a window whose limit is applied before the
shuffle. The bounds are proven, so the result is that of brute force: recall is 1.

Of equal vectors only the k + 1 rows of smallest identifier can be among a query's k nearest besides itself, so
others leave before the tiles, and a query vector is searched once; a group of copies, however large, makes no pairs.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are compared with those
of their dimension. Rows of one identifier are rows each; one without an identifier may be found (ties: last), and
queries are what `is_query` selects. Fewer candidates than k: all. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import FILE, ROW, placed

#: Rows of a block of candidates and of queries, about; and of the products held at a time. A tile returns k rows a query,
#: so blocks of candidates are not cut below LEAST rows for the sake of more tasks.
CANDIDATES, QUERIES, LEAST = 65_536, 16_384, 4_096
TILE_CANDIDATES, TILE_QUERIES = 8_192, 256
#: Components multiplied at a time: sums of so many products of int8 are exact in float32.
EXACT = 1024
#: What float32 arithmetic on products and bounds may add to the error.
SLACK = 4e-6


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class _Block:
    """Vectors of one dimension: doubles, their lengths, int8 with scales, and the length of what rounding took."""

    def __init__(self, x: np.ndarray):
        self.x = _scaled(x)
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        unit = self.x / self.length[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.q * self.scale[:, None]) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 rows by int8 rows, exact."""
    parts = [a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T for i in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def search(queries: np.ndarray, candidates: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Of each query the k best (cosine, place of the candidate), of equal ones the first places; in heap order."""
    q, c = _Block(queries), _Block(candidates)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
    for i in range(0, len(queries), TILE_QUERIES):
        rows = slice(i, i + TILE_QUERIES)
        own = heaps[rows]
        for j in range(0, len(candidates), TILE_CANDIDATES):
            cols = slice(j, j + TILE_CANDIDATES)
            near = _products(q.q[rows], c.q[cols]) * q.scale[rows, None].astype(np.float32) * c.scale[None, cols].astype(np.float32)
            error = (q.error[rows, None] + (1 + q.error[rows, None]) * c.error[None, cols] + SLACK).astype(np.float32)
            least = np.array([h[0][0] if len(h) == k else -2.0 for h in own])
            if near.shape[1] >= k:
                least = np.maximum(least, np.partition(near - error, -k, axis=1)[:, -k])
            a, b = np.nonzero(near + error >= (least - SLACK)[:, None])
            for at in range(0, len(a), 1 << 16):
                left, right = i + a[at : at + (1 << 16)], j + b[at : at + (1 << 16)]
                exact = (q.x[left] * c.x[right]).sum(axis=1) / (q.length[left] * c.length[right])
                for n, m, s in zip(left.tolist(), right.tolist(), exact.tolist(), strict=True):
                    heap, found = heaps[n], (s, -m)
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)
    return [[(s, -m) for s, m in heap] for heap in heaps]


def _by_dimension(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each dimension the rows and their vectors."""
    vectors = table["vector"].combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out[d] = at, flat.astype(np.float64).reshape(-1, d)
    return out


def _tile(k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def tile(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        order = pc.sort_indices(candidates, [("id", "ascending"), (FILE, "ascending"), (ROW, "ascending")], null_placement="at_end")
        candidates = candidates.take(order)
        asked, at, score = [], [], []
        there = _by_dimension(candidates)
        for d, (rows, x) in _by_dimension(queries).items():
            if d not in there:
                continue
            places, y = there[d]
            for row, heap in zip(rows.tolist(), search(x, y, k), strict=True):
                asked += [row] * len(heap)
                at += [places[m] for _, m in heap]
                score += [s for s, _ in heap]
        found, by = candidates.select(["id", FILE, ROW]).take(pa.array(at, pa.int64())), queries.select(["q_file", "q_row"]).take(pa.array(asked, pa.int64()))
        return pa.Table.from_arrays([*by.columns, *found.columns, pa.chunked_array([pa.array(score, pa.float64())])], names=schema.names).cast(schema)

    return tile


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each query among all rows but its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(vectors, F.col(id_col).alias("id"), F.col(vec_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable("vector"))
    place = F.struct(FILE, ROW)
    asking = rows.where("asks")
    n_queries, n_rows = asking.select(FILE).count(), vectors.count()
    query_blocks = max(1, -(-n_queries // QUERIES))
    blocks = max(1, -(-n_rows // CANDIDATES), min(parts // query_blocks, n_rows // LEAST))

    first = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last(), FILE, ROW))
    candidates = rows.select("id", FILE, ROW, "vector").withColumn("nth", first).where(F.col("nth") <= k + 1).drop("nth")
    searched = asking.groupBy("vector").agg(F.min(place).alias("first")).select("vector", F.col(f"first.{FILE}").alias("q_file"), F.col(f"first.{ROW}").alias("q_row"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("*", F.pmod(F.xxhash64(FILE, ROW), F.lit(blocks)).cast("int").alias("block"), every(query_blocks).alias("query_block"))
    right = searched.select("*", F.pmod(F.xxhash64("q_file", "q_row"), F.lit(query_blocks)).cast("int").alias("query_block"), every(blocks).alias("block"))
    schema = left.select(F.col(FILE).alias("q_file"), F.col(ROW).alias("q_row"), "id", FILE, ROW, F.lit(0.0).alias("score")).schema
    tiles = left.groupBy("query_block", "block").cogroup(right.groupBy("query_block", "block"))
    found = tiles.applyInArrow(_tile(k + 1, to_arrow_schema(schema)), schema)

    best = (F.col("score").desc(), F.col("id").asc_nulls_last(), FILE, ROW)
    merged = found.withColumn("nth", F.row_number().over(Window.partitionBy("q_file", "q_row").orderBy(*best))).where(F.col("nth") <= k + 1)
    lists = merged.groupBy("q_file", "q_row").agg(F.sort_array(F.collect_list(F.struct("nth", "id", FILE, ROW, "score"))).alias("found"))  # k + 1 rows at most
    answers = searched.join(lists, ["q_file", "q_row"]).select("vector", "found")
    others = F.slice(F.filter("found", lambda x: ~((x[FILE] == F.col(FILE)) & (x[ROW] == F.col(ROW)))), 1, k)
    told = asking.select(F.col("id").alias("query_id"), FILE, ROW, "vector").join(answers, "vector").select("query_id", F.posexplode(others).alias("at", "x"))
    return told.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), "x.score")
