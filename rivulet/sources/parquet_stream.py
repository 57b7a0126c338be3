"""Parquet files that stand one after the other in a byte stream.

Streams are read wherever Spark splits them: its text source cuts them where one file's last mark meets the next one's
first, so a piece is a Parquet file less those marks, read by the split in which it begins. Each piece must end like a
Parquet file. A stream of which one does not (the two marks stand in its data, or it is damaged) is read from its
beginning, a row a stream; the others stay as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import CorruptFooterError, CorruptHeaderError, RecordError
from rivulet.operators.position import POS

from .lines import frozen, number_rows
from .stores import compression_of, contents, inflate, name_of, numbered, special

MARK = b"PAR1"
#: Least bytes of a file's metadata, and of a file: marks, metadata and its length.
METADATA, LEAST = 9, 21


def _closes(data: bytes, start: int, end: int) -> bool:
    """Whether data[start:end] ends like a Parquet file: a metadata length that fits, and metadata that stops."""
    if end - start < LEAST:
        return False
    length = struct.unpack_from("<I", data, end - 8)[0]
    return METADATA <= length <= end - start - 12 and data[end - 9] == 0


def _closed(payload: Column) -> Column:
    """_closes of a whole payload, in the JVM."""
    size, mark = F.octet_length(payload), F.lit(MARK)
    word = F.concat(*(F.substring(payload, F.lit(-k), F.lit(1)) for k in (5, 6, 7, 8)))
    length = F.conv(F.hex(word), 16, 10).cast("long")
    fits = (length >= METADATA) & (length <= size - 12)
    marked = (F.substring(payload, F.lit(1), F.lit(4)) == mark) & (F.substring(payload, F.lit(-4), F.lit(4)) == mark)
    return (size >= LEAST) & marked & fits & (F.hex(F.substring(payload, F.lit(-9), F.lit(1))) == "00")


def split(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        if data[start : start + 4] != MARK:
            raise CorruptHeaderError(f"no Parquet file begins at byte {start}")
        at = data.find(MARK, start + 4)
        while at >= 0 and not (_closes(data, start, at + 4) and data[at + 4 : at + 8] in (b"", MARK)):
            at = data.find(MARK, at + 1)
        if at < 0:
            raise CorruptFooterError(f"the Parquet file at byte {start} does not end")
        yield data[start : at + 4]
        start = at + 4


def read_parquet_stream(spark: SparkSession, stores: list) -> DataFrame:
    """(__row_idx, payload, __store_idx, __pos): each Parquet file of each stream as bytes. An empty stream has none;
    errors name the stream. Stores that Spark does not read by itself are a row of the scan each."""
    if not stores:
        return spark.createDataFrame([], f"payload binary, __store_idx int, __row_idx long, {POS} long")
    if not special(stores):
        return _by_ranges(spark, list(stores))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own = _files(path, bytes(content))
                yield pd.DataFrame({"path": path, "__row_idx": range(len(own)), "payload": own})

    return numbered(contents(spark, stores).mapInPandas(run, "path string, __row_idx long, payload binary"), stores).drop("path")


def _files(path: str, data: bytes) -> list[bytes]:
    try:
        return list(split(data))
    except RecordError as e:
        raise type(e)(f"{e} ({path})") from e


def _by_ranges(spark: SparkSession, stores: list) -> DataFrame:
    """Streams cut where Spark splits them; those of which a piece is no Parquet file, walked from the beginning."""
    held, files = frozen(spark), list(dict.fromkeys(map(name_of, stores)))
    file, start = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    rows = held.read.option("lineSep", (MARK + MARK).decode()).option("encoding", "ISO-8859-1").text(files)
    piece, mark = F.col("piece"), F.lit(MARK)
    rows = rows.select(F.col("value").cast("binary").alias("piece"), file, start).withColumns(
        {"begins": F.substring("piece", 1, 4) == mark, "ends": F.substring("piece", -4, 4) == mark}
    )
    payload = F.concat(F.when(F.col("begins"), F.lit(b"")).otherwise(mark), piece, F.when(F.col("ends"), F.lit(b"")).otherwise(mark))
    rows = rows.select("file", "start", "begins", "ends", payload.alias("value"))
    odd = _odd(rows.withColumn("mid", F.monotonically_increasing_id()))
    plain = rows.select("file", "start", "value")
    if odd:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, content in zip(batch["file"], map(bytes, batch["content"]), strict=True):
                    yield pd.DataFrame({"file": name, "start": 0, "value": _files(name, inflate(content) if compression_of(name) == "gzip" else content)})

        whole = held.read.format("binaryFile").load(files).select(file, "content").where(F.col("file").isin(odd))
        plain = plain.where(~F.col("file").isin(odd)).unionByName(whole.mapInPandas(run, "file string, start long, value binary"))
    return number_rows(spark, stores, plain).lines().withColumnRenamed("value", "payload")


def _odd(rows: DataFrame) -> list[str]:
    """Streams that are more than their pieces: only the first may hold its first mark, only the last its last one, and
    all must close. One row a split goes through the driver."""
    told = rows.groupBy("file", "start").agg(
        F.min_by("begins", "mid").alias("first"), F.max_by("ends", "mid").alias("last"), F.count_if("begins").alias("begin"),
        F.count_if("ends").alias("end"), F.count_if(~F.coalesce(_closed(F.col("value")), F.lit(False))).alias("bad"),
    )
    of: dict[str, list] = {}
    for r in told.collect():
        of.setdefault(r["file"], []).append(r)
    odd = []
    for file, splits in of.items():
        splits.sort(key=lambda r: r["start"])
        whole = splits[0]["first"] and splits[-1]["last"] and not any(r["bad"] for r in splits)
        if not (whole and sum(r["begin"] for r in splits) == sum(r["end"] for r in splits) == 1):
            odd.append(file)
    return odd
