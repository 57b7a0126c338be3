"""Exact row positions on top of unordered DataFrames, without a global sort in one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

POS = "__pos"
#: Rows of a table that is broadcast: one for each range.
BROADCAST_RANGES = 100_000
#: Rows of a sample for each range of a key that is not a number.
SAMPLED = 100


def range_bounds(df: DataFrame, key: str, ranges: int) -> list:
    """Ascending values that cut a key of any type into about equal ranges: percentiles of numbers, and of a sample of
    about SAMPLED rows a range of anything else."""
    if ranges < 2:
        return []
    own = df.select(F.col(key).alias("k")).where("k is not null")
    if isinstance(own.schema["k"].dataType, NumericType):
        cuts = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
        bounds = own.agg(F.percentile_approx("k", cuts, F.lit(max(10_000, 10 * ranges))).alias("b")).first()["b"]
        return sorted(set(bounds or []))
    n = own.count()
    held = own if n <= SAMPLED * ranges else own.sample(SAMPLED * ranges / n, seed=5)
    part = F.ntile(ranges).over(Window.orderBy("k"))
    last = held.select("k", part.alias("part")).where(F.col("part") < ranges).groupBy("part").agg(F.max("k").alias("k"))
    return sorted({bytes(r["k"]) if isinstance(r["k"], bytearray) else r["k"] for r in last.collect()})  # one row a range


def range_of(key: Column, bounds: list) -> Column:
    """The number of bounds below the key, found in two steps: among every k-th bound, then among the k that follow;
    so a row looks at twice the root of their number."""
    if not bounds:
        return F.lit(0)
    k = isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + k] for i in range(0, len(bounds), k)]
    below = lambda held: F.size(F.filter(held, lambda b: F.coalesce(b < key, F.lit(False))))
    if len(groups) == 1:
        return below(F.lit(bounds))
    coarse = below(F.lit([g[-1] for g in groups]))  # groups that lie below the key as a whole
    within = below(F.element_at(F.array(*map(F.lit, groups)), F.least(coarse + 1, F.lit(len(groups)))))
    return F.when(coarse == len(groups), F.lit(len(bounds))).otherwise(coarse * k + within)


def with_position(df: DataFrame, key: str, ranges: int | None = None, pos: str = POS) -> DataFrame:
    """Adds the 0-based rank of a unique key of any type that has an order; a null comes first, and rows that share a key
    follow each other in any order. Rows are cut into ranges of the key; a task numbers its range and adds the rows of the
    ranges before it, one number a range."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__range", range_of(F.col(key), range_bounds(df, key, ranges)))
    before, total = [], 0
    for r in dealt.groupBy("__range").count().orderBy("__range").collect():  # one row a range
        before.append((r["__range"], total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "__range int, __before long")
    offsets = F.broadcast(offsets) if len(before) <= BROADCAST_RANGES else offsets
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return dealt.withColumn(pos, own).join(offsets, "__range").withColumn(pos, (F.col(pos) + F.col("__before")).cast("long")).drop("__range", "__before")
