"""Medians and captured values of many columns against plain Python, in a number of scans that columns do not change."""

import math
import random

import pytest

from rivulet.operators.insights import MEDIAN_ROWS, analyze, captures, medians


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    """Rows out of order: numbers from the start, late, few, none, odd ones, and a number in every third row."""
    rng = random.Random(8)
    n = 45_000
    rows = []
    for p in range(n):
        late = str(rng.randrange(1000)) if p > 31_000 else "-"
        few = str(p) if p % 9_000 == 17 else ""
        odd = rng.choice(("nan", "inf", "x", None, " 7 ", f"{rng.gauss(0, 9):.4f}"))
        third = str(rng.randrange(99)) if p % 3 == 1 else "no"
        rows.append((p, str(rng.random()), late, few, "text", odd, third))
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("cells"))
    spark.createDataFrame(rows, "p long, dense string, late string, few string, none string, odd string, third string").repartition(5).write.parquet(path, mode="overwrite")
    return spark.read.parquet(path), sorted(rows)


def number(c):
    try:
        x = float(c)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def test_medians(spark, cells):
    df, rows = cells
    names = df.columns[1:]
    got = {r["column"]: r["numeric_finite_median_approx"] for r in medians(df, names, "p").collect()}
    for i, name in enumerate(names, 1):
        first = sorted([x for r in rows if (x := number(r[i])) is not None][:MEDIAN_ROWS])
        want = first[len(first) // 2] if first else math.nan
        assert got[name] == want or math.isnan(got[name]) and math.isnan(want), name
    assert len(got) == len(names)
    (empty,) = medians(df.where("p < 0"), ["dense"], "p").collect()
    assert empty["column"] == "dense" and math.isnan(empty["numeric_finite_median_approx"])


@pytest.mark.parametrize("most", [1, 4, 5, 6, 1000])
def test_captures(spark, cells, most):
    df, rows = cells
    own = df.where("p < 900")
    got = {}
    for r in captures(own, ["none", "odd", "third"], "p", most).collect():
        got.setdefault(r["column"], {})[r["value"]] = (r["n"], r["overflowed"])
    for i, name in ((4, "none"), (5, "odd"), (6, "third")):
        counts = {}
        for r in rows[:900]:
            if r[i] is not None and r[i].strip():
                counts[r[i]] = counts.get(r[i], 0) + 1
        assert got[name] == {v: (n, len(counts) > most) for v, n in list(counts.items())[:most]}


def test_scans_do_not_grow_with_columns(spark, cells):
    df, _ = cells
    scans = lambda names: analyze(df, names, pos="p")._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans(["dense"]) == scans(df.columns[1:]) <= 4
