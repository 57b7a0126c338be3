"""What the corpus operators share: the folder all executors see, and small column helpers."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.staging import discard, new_path, paths

__all__ = ["discard", "documents", "materialise", "new_path", "paths", "placed", "remainder", "text_or_empty", "vocabulary", "written"]

#: The place of a row: a hash of its file's path, and its number in the file.
FILE, ROW = "__file", "__row"


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """df as Parquet at the path, read back."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor
    costs nothing but a reread. The files are removed when the driver ends."""
    return written(df, new_path(df.sparkSession, name), **options)


def placed(df: DataFrame, *columns: Column) -> DataFrame:
    """`columns` with the place of each row, so that rows are told apart whatever their identifiers. The place does not
    depend on how files are split; rows that are not those of files are written first."""
    try:
        return df.select(F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW), *columns)
    except AnalysisException:
        return materialise(df.select(F.lit(0).cast("long").alias(FILE), F.monotonically_increasing_id().alias(ROW), *columns), "placed")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the environment variable RIVULET_TOKENIZERS names another folder."""
    if folder := os.environ.get("RIVULET_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
