"""The buffer shuffle against a buffer that is played row by row with the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import buffer, rows
from rivulet.operators.buffer import Buffer
from rivulet.operators.position import POS


def played(total, window, seed):
    own = Buffer(window, seed, total)
    held, out = list(range(own.window)) if total else [], []
    step = 0
    while len(out) + len(held) < total:
        slot = own.draws(step, step + 1)[0]
        out.append(held[slot])
        held[slot] = step + own.window
        step += 1
    turns = {}
    while len(turns) < len(held):
        turns.setdefault(int(own.draws(step, step + 1)[0]), None)
        step += 1
    return out + [held[s] for s in turns]


@pytest.mark.parametrize("total,window", [(0, 4), (1, 4), (3, 8), (8, 8), (9, 8), (500, 2), (500, 64), (3000, 700)])
@pytest.mark.parametrize("block", [1, 97, 1 << 16])
def test_places(monkeypatch, total, window, block):
    monkeypatch.setattr(buffer, "BLOCK", block)
    own = Buffer(window, 7, total)
    places = own.places(np.arange(total))
    want = played(total, window, 7)
    assert [want[p] for p in places] == list(range(total))
    assert all(p >= i - own.window + 1 for i, p in enumerate(places))
    mixed = np.random.default_rng(1).permutation(total)
    assert (Buffer(window, 7, total).places(mixed) == places[mixed]).all()


def test_draws_are_even_and_far_steps_differ():
    own = Buffer(10, 3, None)
    counts = np.bincount(own.draws(0, 100_000), minlength=10)
    assert counts.min() > 9_500 and counts.max() < 10_500
    far = 1 << 32
    assert (own.draws(far - 5, far + 5)[:5] == own.draws(far - 5, far)).all()
    assert (own.draws(0, 1000) != own.draws(far, far + 1000)).any()
    assert (Buffer(10, 3 + far, None).draws(0, 1000) != own.draws(0, 1000)).any()
    assert (Buffer(10, -4, None).draws(0, 1000) != own.draws(0, 1000)).any()


def test_last_rows_leave_in_any_order():
    """Of three rows in a buffer of three, all six orders come about equally often."""
    seen = {}
    for seed in range(3000):
        order = tuple(Buffer(3, seed, 3).places(np.arange(3)))
        seen[order] = seen.get(order, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 400


def test_rows(spark):
    df = spark.range(0, 5000, 1, 7).withColumn(POS, F.col("id"))
    own = rows.shuffled(df, 5, 64, epoch=1)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {r[POS]: r["id"] for r in own.collect()}
    assert [got[i] for i in range(5000)] == played(5000, 64, 6)
    once = {r[POS]: r["id"] for r in rows.shuffled(df.coalesce(1), 5, 64, epoch=1, once=True).collect()}
    assert once == got
    assert rows.shuffled(df.limit(0), 5, 64).count() == 0
