"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Memtables: rows fall into generations by their identifier; each generation is combined before the shuffle to one
row a digest. Flush: a generation is written as a run, sorted by digest, with a Parquet Bloom filter and row-group
bounds on the digest (what a later `lookup` prunes files by). Compaction: runs merge to one row a digest with the
identifier to keep. Hits: digests of more than one row have their texts compared byte for byte; texts that only share
a digest part ways. The rows are asked for hits through a Bloom filter of the index's hits, so that other texts,
the most of a corpus, are read and never moved.

Null text counts as empty. Repeated rows count as copies; equal identifiers of equal texts tie, and each such row is
returned, as kept where it is the one to keep. A row without an identifier is kept where no copy has one. Further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, new_path, text_or_empty

#: Bits of the filter for each digest that was hit, and of the largest filter that is broadcast (64 MB).
BITS_A_HIT, MOST_BITS = 16, 1 << 29
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def flush_runs(rows: DataFrame, generations: int = 4, path: str | None = None) -> DataFrame:
    """rows (digest, id) to sorted runs: (generation, digest, low_id, high_id, n)."""
    spark = rows.sparkSession
    path = path or new_path(spark, "runs")
    memtable = (
        rows.withColumn("generation", F.pmod(F.xxhash64("id"), F.lit(generations)).cast("int"))
        .groupBy("digest", "generation")
        .agg(F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.count(F.lit(1)).alias("n"))
    )
    (
        memtable.sortWithinPartitions("generation", "digest")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", "100000")
        .partitionBy("generation")
        .parquet(path)
    )
    return spark.read.schema(memtable.schema).parquet(path)


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs to one row a digest."""
    return runs.groupBy("digest").agg(
        F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"), F.sum("n").alias("n")
    )


def lookup(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Index rows of a few digests; run files without them are skipped by bounds and filters."""
    return compact(runs.where(F.col("digest").isin([bytearray(d) for d in digests])))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    generations: int = 4,
    digest=sha256,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, digest (binary).

    keep: "smallest" or "largest" identifier of equal texts. digest: Column -> Column; a weak one only costs more
    comparisons, never a wrong group.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    keeper = F.col("low_id" if keep == "smallest" else "high_id")
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    texts = texts.select("id", "body", digest(F.col("body")).alias("digest"))
    narrow = texts.select("id", "digest")

    index = materialise(compact(flush_runs(narrow, generations)), "index")
    hits = index.where("n > 1").select("digest")
    verified = materialise(by_bytes(texts, hits).select("digest", "low_id", "high_id", "n"), "verified")
    clashes = verified.groupBy("digest").count().where("count > 1").select("digest")

    settled = index.where("n = 1").unionByName(verified)
    if clashes.isEmpty():
        rows = narrow.join(settled, "digest")
    else:
        apart = by_bytes(texts, clashes)
        rows = narrow.join(settled.join(clashes, "digest", "left_anti"), "digest").unionByName(
            texts.join(apart, ["digest", "body"]).drop("body")
        )
    return rows.select(
        F.col("id").alias(id_col), keeper.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(keeper).alias("kept"), "digest"
    )


def hit_filter(hits: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter of one hash over the digests: (bucket, held), a bitmap of 32,768 bits for each bucket."""
    place = _place(bits)
    return hits.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held"))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def pass_filter(texts: DataFrame, held: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest the filter may hold; the others are no hits."""
    at = F.bitmap_bit_position(_place(bits))
    byte = F.conv(F.hex(F.substring("held", F.call_function("div", at, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("bucket", F.bitmap_bucket_number(_place(bits))).join(held, "bucket")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(texts.columns)


def by_bytes(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest was hit, one row for each digest and text: equal digests are compared byte for byte.

    A filter of the hits goes to the rows first, so that texts that were not hit stay where they are; a filter beyond
    MOST_BITS is left out. Texts that pass are combined where they lie, then meet by digest and text, and what is
    no hit after all (a row by itself) falls out with the hits' own digests.
    """
    bits = 1 << max(15, (BITS_A_HIT * max(1, hits.count()) - 1).bit_length())
    if bits <= MOST_BITS:
        texts = pass_filter(texts, F.broadcast(hit_filter(hits, bits)), bits)
        grouped = texts.groupBy("digest", "body").agg(
            F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.count(F.lit(1)).alias("n")
        )
        return grouped.join(hits, "digest", "left_semi")
    spread = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left_semi")
    return found.groupBy("digest", "body").agg(
        F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.count(F.lit(1)).alias("n")
    )
