"""Ranks of keys of any type."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators.position import POS, range_bounds, with_position

KINDS = {
    "string": lambda i, rng: f"{rng.choice('aZé中☃😀')}{rng.random():.9f}{i}",
    "binary": lambda i, rng: rng.randbytes(3) + i.to_bytes(4),
    "date": lambda i, rng: datetime.date(1950, 1, 1) + datetime.timedelta(days=7 * i),
    "decimal(20,3)": lambda i, rng: decimal.Decimal(i * 37 - 9000) / 1000,
    "double": lambda i, rng: rng.gauss(0, 1e6),
    "bigint": lambda i, rng: i * 3 - 700,
}


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_ranks(spark, kind, ranges):
    rng = random.Random(6)
    keys = [KINDS[kind](i, rng) for i in range(5000)]
    rows = [(k,) for k in keys] + [(None,)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"k {kind}").repartition(3)
    got = with_position(df, "k", ranges)
    order = [r["k"] if r["k"] is None or kind != "binary" else bytes(r["k"]) for r in got.orderBy(POS).collect()]
    assert order[0] is None
    assert order[1:] == sorted(keys)
    assert [r[0] for r in got.select(POS).orderBy(POS).collect()] == list(range(5001))


def test_ranges_are_even(spark):
    df = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    bounds = range_bounds(df, "k", 20)
    keys = sorted(r["k"] for r in df.collect())
    sizes = [sum(a < k <= b for k in keys) for a, b in zip(["", *bounds], [*bounds, "~"], strict=True)]
    assert len(bounds) == 19 and max(sizes) < 2200


def test_few_keys(spark):
    for rows in ([], [("a",)], [("a",), ("a",), (None,)], [(None,), (None,)]):
        df = spark.createDataFrame(rows, "k string")
        assert sorted(r[POS] for r in with_position(df, "k", 5).collect()) == list(range(len(rows)))
