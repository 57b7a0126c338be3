"""Text lines with exact positions: counted split by split, shifted by the rows of the splits before.

UTF-8, and any encoding in which line ends are the bytes they are in ASCII, goes through Spark's text source, split by
split, also where quoted fields hold line ends. Files of 16 or 32 bits a character are cut split by split as well (`wide`),
but for those with quoted line ends; these, and files that are compressed without saying so in their name, are read
whole, a file a row.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import StreamError
from rivulet.operators.position import POS

from .quoted import LINE_END, cut_splits
from .stores import BROADCAST_BYTES, contents, local_table, name_of, plain, special
from .wide import by_encoding, heads, wide_lines

#: Byte order marks, the longest first.
MARKS = {b"\xff\xfe\x00\x00": "utf-32", b"\x00\x00\xfe\xff": "utf-32", b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
#: Fixed value: a name of Latin-1 that Python does not know.
LATIN = {"8859_1": "iso8859-1"}


def decode(data: bytes, encoding: str | None) -> str:
    """By the encoding, or by the byte order mark where there is none."""
    own = LATIN.get(encoding, encoding) or next((e for mark, e in MARKS.items() if data.startswith(mark)), "utf-8")
    try:
        return data.decode(own, "strict" if encoding else "replace").removeprefix("﻿")
    except (UnicodeDecodeError, LookupError) as e:
        raise StreamError(f"the text is not {own}") from e


def line_ends_are_plain(encoding: str) -> bool:
    """Whether line ends, and nothing else, are the bytes they are in ASCII, so that Spark can split files there."""
    try:
        name = codecs.lookup(LATIN.get(encoding, encoding)).name
    except LookupError as e:
        raise StreamError(f"unknown encoding {encoding!r}") from e
    return not name.startswith(("utf-16", "utf-32", "utf-7", "iso2022", "hz")) and "\r\n".encode(name) == b"\r\n"


def decoded(column: Column, encoding: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([decode(bytes(v), encoding) for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(column.cast("binary"))


def split_lines(text: str) -> list[str]:
    own = re.split(LINE_END, text)
    return own if own[-1] else own[:-1]


def frozen(spark: SparkSession) -> SparkSession:
    """A session like this one whose split plan stays what it is now: what is read in it is cut and dealt to partitions
    alike however often, whatever becomes of settings and executors. Row numbers rest on that."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    least = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    own.conf.set("spark.sql.files.minPartitionNum", least or spark.sparkContext.defaultParallelism)
    return own


def _whole(held: SparkSession, stores: list, encoding: str | None, compression: str | None, records: Callable[[str], list[str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame({"file": path, "start": 0, "value": records(decode(bytes(content), encoding))})

    return contents(held, stores, compression).mapInPandas(run, "file string, start long, value string")


def is_wide(encoding: str) -> bool:
    """Whether characters take 16 or 32 bits."""
    return codecs.lookup(LATIN.get(encoding, encoding)).name.startswith(("utf-16", "utf-32"))


def _wide(spark: SparkSession, stores: list, keep: Column | None, encoding: str | None) -> Numbered:
    """Lines of files of which some have 16 or 32 bits a character: all by `encoding`, or those whose mark says so."""
    held, files = frozen(spark), list(dict.fromkeys(map(name_of, stores)))
    parts = []
    for own, named in by_encoding(files, heads(held, files).collect(), encoding, lambda f: plain(unquote(f))).items():  # one row a file
        if own is not None:
            parts.append(wide_lines(spark, held, named, own, strict=encoding is not None))
            continue
        rows = held.read.text(named).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        parts.append(rows.withColumn("value", F.when(F.col("start") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))))
    rows = reduce(DataFrame.unionByName, parts)
    return number_rows(spark, stores, rows if keep is None else rows.where(keep))


@dataclass(frozen=True)
class Numbered:
    """Lines of stores (value, file, start, mid): mid counts within a partition of the read, whose split plan is frozen.
    splits: (store, file, start, least mid, lines) of each split of each store in order."""

    spark: SparkSession
    rows: DataFrame
    splits: list[tuple[int, str, int, int, int]]

    def counts(self) -> dict[int, int]:
        """Lines of each store that has any."""
        out: dict[int, int] = {}
        for store, _, _, _, n in self.splits:
            out[store] = out.get(store, 0) + n
        return out

    def lines(self, head: int = 0, single: bool = False) -> DataFrame:
        """(value, __store_idx, __row_idx, __pos), with the fields of quoted records if they were cut; the first `head`
        lines of each store (single: of the first store that has lines) are left out, and positions count what is there."""
        counts, shifts, at, in_store, last, drop = self.counts(), [], 0, 0, None, 0
        for store, file, start, low, n in self.splits:
            if store != last:
                in_store, drop = 0, min(head, counts[store]) if not single or last is None else 0
                at, last = at - drop, store
            shifts.append((file, start, store, in_store - low, at - low, drop))
            at, in_store = at + n, in_store + n
        table = local_table(self.spark, shifts, "file string, start long, __store_idx int, in_store long, in_all long, drop int")
        table = F.broadcast(table) if sum(len(s[0]) + 48 for s in shifts) <= BROADCAST_BYTES else table
        told = [c for c in ("fields", "unread") if c in self.rows.columns]
        joined = table.join(self.rows, ["file", "start"], "right").select(
            "value", "__store_idx", (F.col("mid") + F.col("in_store")).alias("__row_idx"), (F.col("mid") + F.col("in_all")).alias(POS), "drop", *told
        )
        lost = F.raise_error(F.lit("StreamError: the files are cut otherwise than when they were counted"))
        return joined.where(F.when(F.col("__store_idx").isNull(), lost).otherwise(F.col("__row_idx") >= F.col("drop"))).drop("drop")


def number_lines(
    spark: SparkSession,
    stores: list,
    keep: Column | None = None,
    encoding: str | None = None,
    compression: str | None = None,
    records: Callable[[str], list[str]] | None = None,
    whole: bool = False,
) -> Numbered:
    """The lines of the stores (files or sources of one's own) in order; keep drops lines before numbering.

    encoding: None follows the byte order marks, UTF-8 without. compression: None is each store's own, by suffix as a
    rule; "gzip" also reads zlib. records: cuts a text in place of line ends, split by split if it has a dialect. whole:
    a store a row.

    A store may be empty, or stand in the list several times. Two scans and no shuffle of the lines; the driver gets
    one row for each file split.
    """
    utf8 = (encoding or "UTF-8").upper() in ("UTF-8", "UTF8")
    dialect = getattr(records, "dialect", None)
    if not whole and records is None and not special(stores, compression) and not utf8 and not line_ends_are_plain(encoding) and is_wide(encoding):
        return _wide(spark, stores, keep, encoding)
    whole = whole or (records is not None and dialect is None) or special(stores, compression) or not (utf8 or line_ends_are_plain(encoding))
    held, completed = frozen(spark), None
    if whole:
        rows = _whole(held, stores, encoding, compression, records or split_lines).withColumn("marked", F.lit(False))
    else:
        files = list(dict.fromkeys(map(name_of, stores)))
        reader = held.read if dialect is None else held.read.option("lineSep", "\n")
        rows = reader.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        if not utf8:
            rows = rows.withColumn("value", decoded(F.col("value"), encoding))
        head = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
        wide = head.startswith("FFFE") | head.startswith("FEFF") | (head == "0000FEFF")
        first = F.col("start") == 0
        rows = rows.withColumns({"marked": F.lit(encoding is None) & first & wide, "value": F.when(first, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))})
    if dialect is not None and not whole:
        cut = cut_splits(held, rows.select(F.when(~F.col("marked"), F.col("value")).alias("value"), "file", "start"), dialect, records.tokenize)
        if cut is None:  # 16 or 32 bits a character
            return number_lines(spark, stores, keep, None, compression, records, True)
        rows, full, completed = cut
        full = full if keep is None else full.where(keep)
    if keep is not None:
        rows = rows.where(keep)
    own = number_rows(spark, stores, rows, as_uri=not whole)
    if own is None and dialect is None:  # 16 or 32 bits a character
        return _wide(spark, stores, keep, None)
    if own is None:
        return number_lines(spark, stores, keep, None, compression, records, True)
    return own if completed is None else replace(own, rows=completed(full.withColumn("mid", F.monotonically_increasing_id())))


def number_rows(spark: SparkSession, stores: list, rows: DataFrame, as_uri: bool = True) -> Numbered | None:
    """rows (file, start, value) of a frozen read in order; None if any is `marked`. as_uri: file is a path in Spark's
    own writing."""
    rows = rows.withColumn("mid", F.monotonically_increasing_id())
    marked = F.max("marked") if "marked" in rows.columns else F.lit(False)
    splits = rows.groupBy("file", "start").agg(F.min("mid").alias("low"), F.count(F.lit(1)).alias("n"), marked.alias("marked")).collect()
    if any(s["marked"] for s in splits):
        return None
    of: dict[str, list] = {}
    for s in splits:
        of.setdefault(plain(unquote(s["file"]) if as_uri else s["file"]), []).append((s["file"], s["start"], s["low"], s["n"]))
    placed = [(i, *s) for i, store in enumerate(stores) for s in sorted(of.get(plain(name_of(store)), ()), key=lambda s: s[1])]
    return Numbered(spark, rows.drop("marked"), placed)


def read_lines(spark: SparkSession, stores: list, keep: Column | None = None, encoding: str | None = None, compression: str | None = None, records: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(value, __store_idx, __row_idx, __pos) of number_lines."""
    if not stores:
        return spark.createDataFrame([], f"value string, __store_idx int, __row_idx long, {POS} long")
    return number_lines(spark, stores, keep, encoding, compression, records).lines()
