"""Sketches as a binary column, against the table of registers and true counts."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import sketch


def test_groups_and_merges(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 5000).cast("string").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"))
    sketch.sketches(df, "v", ["g", "h"]).write.parquet(str(tmp_path / "s"))
    held = spark.read.parquet(str(tmp_path / "s"))
    assert held.count() == 6
    got = {r["g"]: bytes(r["sketch"]) for r in sketch.merge_sketches(held, ["g"]).collect()}
    assert got == {r["g"]: bytes(r["sketch"]) for r in sketch.sketches(df, "v", ["g"]).collect()} and set(got) == {None, 1, 2}
    (row,) = sketch.merge_sketches(held).select("sketch", sketch.cardinality().alias("n")).collect()
    assert row["n"] == pytest.approx(sketch.estimate(sketch.registers(df, "v")).first()[0])
    assert abs(row["n"] - 5000) < 50
    table = {(r["register"], r["rank"]) for r in sketch.registers(df, "v").collect()}
    assert set(zip(*(x.tolist() for x in sketch.unpacked(bytes(row["sketch"]))), strict=True)) == table


def test_dense(spark):
    """Beyond a third of the registers all ranks are kept; the bytes do not tell how a sketch came about."""
    df = spark.range(300_000).select("id", (F.col("id") % 4).alias("g"))
    whole = sketch.sketches(df, "id").select("sketch", sketch.cardinality().alias("n")).first()
    assert len(whole["sketch"]) == sketch.REGISTERS and abs(whole["n"] - 300_000) < 6000
    merged = sketch.merge_sketches(sketch.sketches(df, "id", ["g"])).first()
    assert bytes(merged["sketch"]) == bytes(whole["sketch"])


def test_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x"), ("b", "x"), (None, "y")], "g string, v string")
    got = {r["g"]: (len(r["sketch"]), r["n"]) for r in sketch.sketches(df, "v", ["g"]).select("g", "sketch", sketch.cardinality().alias("n")).collect()}
    assert got["a"] == (0, 0.0) and got["b"] == (3, pytest.approx(1, abs=0.01)) and got[None] == (3, pytest.approx(1, abs=0.01))
    assert bytes(sketch.sketches(df.limit(0), "v").first()["sketch"]) == b""
    assert sketch.sketches(df.limit(0), "v", ["g"]).count() == 0
    odd = spark.createDataFrame([(None,), (bytearray(b""),)], "sketch binary")
    assert bytes(sketch.merge_sketches(odd).first()["sketch"]) == b"" and [r[0] for r in odd.select(sketch.cardinality()).collect()] == [None, 0.0]
    with pytest.raises(ValueError):
        sketch.unpacked(b"1234")
