"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, then language, then source; leaves are what the data holds. A token budget is handed down: each
node shares its budget among its children by weight, no child getting more than it can give (its tokens times
`max_epochs`); what a child cannot use goes to its siblings by weight first, and reaches the parent's siblings only
when all children are full. Each leaf then reads its documents in seeded random order, one order an epoch, up to its
budget; the document in which the budget ends is cut to a prefix of its tokens.

Leaf totals are summed before they are collected: one row a leaf, `max_leaves` at most (more is an error). Prefix
sums within a leaf run over slices of the random order, so no task gets a whole leaf.

Tokens are words between white space; null text counts as empty (no tokens, never selected). Null language or source
is a leaf of its own, ''. Repeated rows are read each; ties of the random order go by the identifier. Rows without an
identifier share one place in the order. Weights that are not named are 1; weights of 0 give nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty

#: Slices of a leaf's random order: 16 to the power of this many hexadecimal digits.
SLICE_DIGITS = 3
LEAF = ("domain", "lang", "source")


def share(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Parts of budget by weight, none above its room; what is left over goes to the others by weight."""
    out, open_ = [0.0] * len(room), [i for i, (w, r) in enumerate(zip(weights, room, strict=True)) if w > 0 and r > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] <= weights[i] * each]
        if not full:
            for i in open_:
                out[i] = weights[i] * each
            break
        for i in full:
            out[i] = room[i]
            left -= room[i]
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def allot(budget: float, leaves: dict[tuple, float], weights: dict[tuple, float]) -> dict[tuple, float]:
    """Budget of every leaf. leaves: what each can give; weights: by path, of one name up to the leaf's."""

    depth = len(next(iter(leaves))) if leaves else 0
    room: defaultdict[tuple, float] = defaultdict(float)  # what each node can use: leaves under it that no weight of 0 bars
    children: defaultdict[tuple, set] = defaultdict(set)
    for leaf, n in leaves.items():
        for k in range(depth, -1, -1):
            room[leaf[:k]] += n
            if k:
                children[leaf[: k - 1]].add(leaf[:k])
                if weights.get(leaf[:k], 1.0) <= 0:
                    n = 0.0
    out, waiting = {}, [((), budget)] if leaves else []
    while waiting:
        path, amount = waiting.pop()
        if len(path) == depth:
            out[path] = amount
            continue
        own = sorted(children[path])
        waiting += zip(own, share(amount, [weights.get(c, 1.0) for c in own], [room[c] for c in own]), strict=True)
    return out


def tokens(text: Column) -> Column:
    """Words between white space. Over Arrow batches, as splitting in the JVM costs three times as much. Marked so
    that no filter moves past it: else a task holds two Python workers, and both read every text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) for t in texts], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long").asNondeterministic()(text)


def quotas(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """plan as rows (leaf, epoch, quota). From Arrow: rows of a list go through Python workers of their own kind, which stay
    in the executors' memory."""
    schema = pa.schema([*((c, pa.string()) for c in LEAF), ("epoch", pa.int32()), ("quota", pa.int64())])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in plan], schema))


def mix(
    docs: DataFrame,
    budget: float,
    weights: dict[tuple, float] | None = None,
    domain: Callable[[], Column] | None = None,
    max_epochs: int = 1,
    seed: int = 7,
    max_leaves: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_by: Column | None = None,
) -> DataFrame:
    """(id, domain, lang, source, epoch, n_tokens, take_tokens): the documents selected, once an epoch.

    budget: tokens, or below 1 that share of what there is. domain: names the top of the tree; one domain by default.
    order_by: what the random order is drawn from with the seed, the identifier by default.
    """
    top = domain() if domain else F.lit("all")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.col(id_col) if order_by is None else order_by).cast("string").alias("name"), F.coalesce(top, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        tokens(text_or_empty(text_col)).alias("n_tokens"),
    )
    rows = materialise(rows.where("n_tokens > 0"), "sized")
    totals = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n")).limit(max_leaves + 1).collect()
    if len(totals) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    room = {tuple(r[c] for c in LEAF): float(r["n"]) for r in totals}
    if not room:
        return rows.select(F.col("id").alias(id_col), *LEAF, F.lit(0).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    goal = budget * sum(room.values()) if budget < 1 else budget
    parts = allot(goal, {k: v * max_epochs for k, v in room.items()}, weights or {})
    plan = [(*k, e, int(min(room[k], round(v) - e * room[k]))) for k, v in parts.items() for e in range(max_epochs) if round(v) - e * room[k] > 0]
    return select_prefixes(rows, quotas(rows.sparkSession, plan), seed, id_col)


def select_prefixes(rows: DataFrame, quota: DataFrame, seed: int, id_col: str) -> DataFrame:
    """rows (id, name, leaf, n_tokens) in the order of their epoch up to the leaf's quota."""
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("epoch"), F.col("name")).cast("binary"))
    dealt = rows.join(F.broadcast(quota), list(LEAF)).withColumn("order", order).withColumn("slice", F.substring("order", 1, SLICE_DIGITS))
    leaf = (*LEAF, "epoch")
    sums = dealt.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*leaf, "slice", before.alias("start"))
    placed = dealt.join(starts, [*leaf, "slice"])
    whole = Window.partitionBy(*leaf, "slice").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("n_tokens").over(whole), F.lit(0))
    return (
        placed.withColumn("at", at)
        .where("at < quota")
        .select(F.col("id").alias(id_col), *leaf, "n_tokens", F.least("n_tokens", F.col("quota") - F.col("at")).alias("take_tokens"))
    )


def named_weights(pairs: Iterable[tuple[str, float]]) -> dict[tuple, float]:
    """'domain/lang/source' paths, of any depth, to weights."""
    return {tuple(path.split("/")): weight for path, weight in pairs}
