"""Row operators in closed form over the row position: each is a filter and new positions, mostly with no sort or window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import InvalidInstanceError
from rivulet.params import BadExampleHandling, LastExampleHandling, ReaderParams

from .buffer import place
from .position import POS, with_position

SAMPLE_BLOCK = 100


def skip_read(df: DataFrame, skip: int = 0, read: int | None = None, pos: str = POS) -> DataFrame:
    kept = F.col(pos) >= skip
    if read is not None:
        kept &= F.col(pos) < skip + read
    return df.where(kept).withColumn(pos, F.col(pos) - skip)


def shard(df: DataFrame, shards: int, index: int, pos: str = POS) -> DataFrame:
    if shards <= 1:
        return df
    if not 0 <= index < shards:
        raise ValueError("shard_index must be below num_shards")
    return df.where(F.col(pos) % shards == index).withColumn(pos, F.floor(F.col(pos) / shards).cast("long"))


def sampled(ratio: float, rows: int) -> int:
    """Rows kept of a block, in single precision."""
    return int(np.float32(ratio) * np.float32(rows))


def sample(df: DataFrame, ratio: float, total: int, pos: str = POS) -> DataFrame:
    """The first rows of each block of 100; total: rows of df. The stream ends at a full block that gives none."""
    full = sampled(ratio, SAMPLE_BLOCK)
    last, rest = total // SAMPLE_BLOCK, total % SAMPLE_BLOCK
    block, place = F.floor(F.col(pos) / SAMPLE_BLOCK).cast("long"), F.col(pos) % SAMPLE_BLOCK
    quota = F.when(block < last, F.lit(full)).otherwise(F.lit(sampled(ratio, rest)))
    kept = place < quota
    if full == 0:
        kept &= F.lit(last == 0)
    return df.where(kept).withColumn(pos, block * full + place)


def shuffled(
    df: DataFrame, seed: int, window: int = 0, epoch: int = 0, reshuffle: bool = True, pos: str = POS, total: int | None = None, once: bool = False
) -> DataFrame:
    """The rows at new positions: in any order (window 0, ranges of a hash are ranked side by side), or as they leave a
    buffer of `window` rows. total: rows of df, counted where it is not given; once: df is one partition that cannot be
    counted before it is read, and is sorted."""
    if window == 1:
        return df
    seed += epoch if reshuffle else 0
    if window == 0:
        chance = F.xxhash64(F.lit(seed), pos)  # one to one for positions
        return with_position(df.withColumn("__chance", chance), "__chance", pos=pos).drop("__chance")
    if not once:
        return df.withColumn(pos, place(pos, window, seed, df.count() if total is None else total))
    left = df.withColumn("__left", place(pos, window, seed, None))
    return left.withColumn(pos, (F.row_number().over(Window.orderBy("__left")) - 1).cast("long")).drop("__left")


def chain(df: DataFrame, params: ReaderParams, total: int | None = None, pos: str = POS) -> DataFrame:
    """Skip and limit, shard and sample by the parameters; total is counted only for a sample."""
    df = skip_read(df, params.num_instances_to_skip, params.num_instances_to_read, pos)
    if params.num_shards > 1:
        df = shard(df, params.num_shards, params.shard_index, pos)
    if params.sample_ratio is not None:
        if total is None:
            rows = df.count()
        else:
            rows = max(0, total - params.num_instances_to_skip)
            rows = rows if params.num_instances_to_read is None else min(rows, params.num_instances_to_read)
            if params.num_shards > 1:
                rows = max(0, -(-(rows - params.shard_index) // params.num_shards))
        df = sample(df, params.sample_ratio, rows, pos)
    return df


def with_batch(df: DataFrame, size: int, pos: str = POS) -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(pos) / size).cast("long"))


def _cells(name: str) -> Column:
    return F.transform("rows", lambda r: r[name])


def batches(
    df: DataFrame,
    columns: dict[str, object],
    size: int,
    last: LastExampleHandling = LastExampleHandling.NONE,
    bad: Column | None = None,
    on_bad: BadExampleHandling = BadExampleHandling.ERROR,
    pos: str = POS,
    details: bool = False,
) -> DataFrame:
    """One row per batch: batch_id, size (rows with padding), padding, and an array of each column in row order.

    columns: name to padding value. bad: true, or the reason, for rows that do not decode; ERROR raises, SKIP drops the
    batch, PAD drops the row and pads the batch. details: dropped batches stay, nothing is raised, and columns are added:
    __dropped, __row_notes and __notes (what befell rows and the batch, in words), __bytes (of the rows' payloads, where
    df has them) and __error (what ERROR would have raised first).
    """
    reason = F.lit(None).cast("string") if bad is None else bad
    if dict(df.select(reason.alias("r")).dtypes)["r"] == "boolean":
        reason = F.when(reason, F.lit("the row does not decode"))
    reason = F.when(reason.isNotNull(), F.concat(F.lit("row "), F.col(pos).cast("string"), F.lit(": "), reason))
    if on_bad is BadExampleHandling.ERROR and bad is not None and not details:
        raised = F.raise_error(F.concat(F.lit(f"{InvalidInstanceError.__name__}: "), reason))
        reason = F.when(reason.isNotNull(), raised).otherwise(F.lit(None).cast("string"))
    df = df.withColumn("__reason", reason)
    good = F.col("__reason").isNull()
    row = F.struct(F.col(pos).alias("p"), *(F.col(c) for c in columns))
    told = [F.count(F.lit(1)).alias("n"), F.count("__reason").alias("n_bad"), F.sort_array(F.collect_list(F.when(good, row))).alias("rows")]
    if details:
        own = F.col("__note") if "__note" in df.columns else F.lit(None).cast("string")
        note = F.concat_ws("; ", "__reason", F.when(own.isNotNull(), F.concat(F.lit("row "), F.col(pos).cast("string"), F.lit(": "), own)))
        told.append(F.min_by("__reason", F.when(~good, F.col(pos))).alias("first"))
        told.append(F.sort_array(F.collect_list(F.when(note != "", F.struct(pos, note.alias("note"))))).alias("notes"))
        told.append((F.sum(F.when(good, F.col("__bytes"))) if "__bytes" in df.columns else F.lit(0)).cast("long").alias("bytes"))
    grouped = with_batch(df, size, pos).groupBy("batch_id").agg(*told)
    any_bad, short = F.col("n_bad") > 0, F.col("n") < size
    skips = on_bad in (BadExampleHandling.SKIP, BadExampleHandling.SKIP_WARN)
    drops = last in (LastExampleHandling.DROP, LastExampleHandling.DROP_WARN)
    dropped = (any_bad if skips else F.lit(False)) | (short if drops else F.lit(False))
    pads = last in (LastExampleHandling.PAD, LastExampleHandling.PAD_WARN)
    whole = F.lit(size) if pads else F.col("n")
    padding = (whole - F.size("rows")).cast("int")
    batch = lambda what: F.concat(F.lit("batch "), F.col("batch_id").cast("string"), F.lit(what))
    said = [
        F.when(any_bad, batch(" is skipped, as rows of it are bad")) if on_bad is BadExampleHandling.SKIP_WARN else None,
        F.when(any_bad, batch(" is padded, as rows of it are bad")) if on_bad is BadExampleHandling.PAD_WARN else None,
        F.when(short, batch(" is dropped, as it is short")) if last is LastExampleHandling.DROP_WARN else None,
        F.when(short, batch(" is padded, as it is short")) if last is LastExampleHandling.PAD_WARN else None,
    ]
    extra = []
    if details:
        said = F.array_compact(F.array(F.lit(None).cast("string"), *(x for x in said if x is not None)))
        extra = [dropped.alias("__dropped"), F.transform("notes", lambda x: x["note"]).alias("__row_notes"), said.alias("__notes"), F.coalesce("bytes", F.lit(0).cast("long")).alias("__bytes")]
        extra.append((F.col("first") if on_bad is BadExampleHandling.ERROR else F.lit(None).cast("string")).alias("__error"))
    else:
        grouped = grouped.where(~dropped)
    return grouped.select(
        "batch_id", whole.cast("int").alias("size"), padding.alias("padding"),
        *(F.concat(_cells(c), F.array_repeat(F.lit(v).cast(df.schema[c].dataType), padding)).alias(c) for c, v in columns.items()), *extra,
    )
