"""A cardinality sketch with fixed registers, equal wherever the same values were seen: 16 index bits of a 32-bit hash.

Registers are made in each task and merged by maximum: at most 65,536 rows a task are shuffled, or a task and group. A sketch
is a table of registers (`registers`, `merge`, `estimate`), or a binary column that can be written, read again, merged over
any groups and estimated (`sketches`, `merge_sketches`, `cardinality`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the sketch.
BITS = 16
REGISTERS = 1 << BITS
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def _ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register and rank of 32-bit hashes."""
    low = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
    zeros = BITS - np.ceil(np.log2(low + 1)).astype(np.int32)
    return (h >> np.uint64(32 - BITS)).astype(np.int32), zeros + 1


def registers(df: DataFrame, column: str) -> DataFrame:
    """(register, rank) of the non-empty values; null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        top = np.zeros(REGISTERS, np.int32)
        for batch in batches:
            h = np.fromiter((xxhash.xxh32_intdigest(bytes(v)) for v in batch["v"]), np.uint64, len(batch))
            np.maximum.at(top, *_ranked(h))
        at = np.flatnonzero(top)
        yield pd.DataFrame({"register": at.astype(np.int32), "rank": top[at]})

    values = df.select(F.col(column).cast("string").cast("binary").alias("v")).where("octet_length(v) > 0")
    return values.mapInPandas(run, "register int, rank int").groupBy("register").agg(F.max("rank").alias("rank"))


def merge(*sketches: DataFrame) -> DataFrame:
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy("register").agg(F.max("rank").alias("rank"))


def estimate(sketch: DataFrame, name: str = "cardinality") -> DataFrame:
    """One row with the estimate, a double: linear counting where small, corrected where hashes run out."""
    seen = sketch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"))
    zeros = F.lit(REGISTERS) - F.col("n")
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (F.col("s") + zeros)
    two32 = float(1 << 32)
    linear = F.lit(float(REGISTERS)) * F.log(F.lit(float(REGISTERS)) / zeros)
    out = F.when((raw <= 2.5 * REGISTERS) & (zeros > 0), linear).when(raw > two32 / 30, -two32 * F.log(1 - raw / two32)).otherwise(raw)
    return seen.select(out.alias(name))


#: A packed sketch: its registers in order, 3 bytes each (number, low byte first, and rank), or, where that is shorter, the
#: ranks of all registers. The same values give the same bytes, whatever their order and however they were merged.
CELL = np.dtype([("register", "<u2"), ("rank", "u1")])


def packed(register: np.ndarray, rank: np.ndarray) -> bytes:
    if len(register) * CELL.itemsize >= REGISTERS:
        dense = np.zeros(REGISTERS, np.uint8)
        dense[register] = rank
        return dense.tobytes()
    cells = np.empty(len(register), CELL)
    cells["register"], cells["rank"] = register, rank
    return np.sort(cells, order="register").tobytes()


def unpacked(sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Registers that are not empty and their ranks; ValueError if the bytes are no sketch."""
    if len(sketch) == REGISTERS:
        dense = np.frombuffer(sketch, np.uint8)
        at = np.flatnonzero(dense)
        return at.astype(np.int32), dense[at].astype(np.int32)
    if len(sketch) % CELL.itemsize or len(sketch) > REGISTERS:
        raise ValueError(f"{len(sketch)} bytes are no sketch")
    cells = np.frombuffer(sketch, CELL)
    return cells["register"].astype(np.int32), cells["rank"].astype(np.int32)


def _hashed(value: pd.Series) -> pd.DataFrame:
    import xxhash

    h = np.fromiter((xxhash.xxh32_intdigest(bytes(v or b"")) for v in value), np.uint64, len(value))
    register, rank = _ranked(h)
    return pd.DataFrame({"register": register, "rank": rank})


def _pack(cells: pd.Series) -> pd.Series:
    def one(own) -> bytes:
        register, rank = (np.fromiter((c[k] for c in own), np.int64, len(own)) for k in ("register", "rank"))
        return packed(register, rank)

    return pd.Series([one(c) for c in cells])


def _unpack(sketch: pd.Series) -> pd.Series:
    return pd.Series([[{"register": int(a), "rank": int(b)} for a, b in zip(*unpacked(bytes(s)), strict=True)] if s is not None else [] for s in sketch])


def _cardinality(sketch: pd.Series) -> pd.Series:
    def one(rank: np.ndarray) -> float:
        zeros = REGISTERS - len(rank)
        raw = ALPHA * REGISTERS * REGISTERS / (float(np.sum(np.exp2(-rank.astype(np.float64)))) + zeros)
        if raw <= 2.5 * REGISTERS and zeros:
            return REGISTERS * float(np.log(REGISTERS / zeros))
        two32 = float(1 << 32)
        return -two32 * float(np.log1p(-raw / two32)) if raw > two32 / 30 else raw

    return pd.Series([None if s is None else one(unpacked(bytes(s))[1]) for s in sketch], dtype="float64")


for _f, _out in ((_hashed, pd.DataFrame), (_pack, pd.Series), (_unpack, pd.Series), (_cardinality, pd.Series)):
    _f.__annotations__ = {next(iter(_f.__code__.co_varnames)): pd.Series, "return": _out}


def _grouped(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch) of rows (by, register, rank). A group's registers are merged side by side, so a group that holds most
    rows is no task's; then each group is one row of at most 65,536 of them."""
    least = cells.groupBy(*by, "register").agg(F.max("rank").alias("rank"))
    held = F.collect_list(F.when(F.col("register").isNotNull(), F.struct("register", "rank")))
    return least.groupBy(*by).agg(held.alias("cells")).select(*by, F.pandas_udf(_pack, "binary")("cells").alias("sketch"))


def sketches(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch), a sketch of the non-empty values of each group, null groups included; null counts as empty, and a
    group with no other values has the empty sketch."""
    value = F.col(column).cast("string").cast("binary")
    told = df.select(*by, value.alias("__v")).withColumn("__c", F.when(F.octet_length("__v") > 0, F.pandas_udf(_hashed, "register int, rank int")("__v")))
    return _grouped(told.select(*by, F.col("__c.register").alias("register"), F.col("__c.rank").alias("rank")), list(by))


def merge_sketches(df: DataFrame, by: Sequence[str] = (), sketch: str = "sketch") -> DataFrame:
    """(by, sketch) of the union of the values that the sketches of each group have seen; null is an empty one."""
    told = df.select(*by, F.explode_outer(F.pandas_udf(_unpack, "array<struct<register: int, rank: int>>")(sketch)).alias("__c"))
    return _grouped(told.select(*by, F.col("__c.register").alias("register"), F.col("__c.rank").alias("rank")), list(by))


def cardinality(sketch: str = "sketch") -> Column:
    """The estimate of a column of sketches, a double, as `estimate` gives it; null of null."""
    return F.pandas_udf(_cardinality, "double")(sketch)
