"""Text of 16 or 32 bits a character, cut into lines wherever Spark splits the files.

Spark's text source cuts the bytes of the files at those of a line feed; across two characters the same bytes may stand
for something else. A cut is a line end if it lies at a whole number of characters from the beginning of the file. How
many bytes lie before a split follows from the lengths of the pieces of the splits before it, whatever these hold; so
one pass counts, for each split, its bytes and whether any cut in it would be a line end at either alignment, and the
driver adds them up, one row a split. In the second pass every split joins its pieces to lines; a line that goes on
beyond its split (a cut that was none, at its very end) is put together from its pieces, which alone are shuffled.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import StreamError

from .quoted import HEAD, RECORD, REST, by_split, with_splits
from .staging import new_path

#: Byte order marks of encodings, the longest first.
ORDERS = {b"\xff\xfe\x00\x00": "utf-32-le", b"\x00\x00\xfe\xff": "utf-32-be", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


def order_of(encoding: str, head: bytes) -> str:
    """The encoding with its byte order: its own, or that of the mark at the file's head, or else little-endian."""
    name = codecs.lookup(encoding).name
    if name.endswith(("-le", "-be")):
        return name
    return next((o for mark, o in ORDERS.items() if o.startswith(name) and head.startswith(mark)), f"{name}-le")


def _counted(width: int, feed: int):
    """(file, start, bytes, aligned): aligned has a 1 for each place of the split's beginning within a character at which one
    of its cuts would be a line end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start, _), pieces in by_split(batches):
            length, aligned = 0, [0] * width
            for piece in pieces:
                aligned[-(length + len(piece)) % width] = 1
                length += len(piece) + feed
            yield pd.DataFrame([(file, start, length, bytes(aligned))], columns=["file", "start", "bytes", "aligned"])

    return run


def _states(told: list, width: int, feed: int) -> list[tuple]:
    """(file, start, bytes before it, the split where the line that it begins within began or -1)."""
    out, file = [], None
    for s in sorted(told, key=lambda s: (s["file"], s["start"])):
        if s["file"] != file:
            file, at, owner = s["file"], 0, -1
        out.append((file, s["start"], at, owner))
        ends = bytes(s["aligned"])[at % width]
        at += s["bytes"]
        within = (at - feed) % width != 0
        owner = -1 if not within else s["start"] if ends or owner < 0 else owner
    return out


def _joined(width: int, mark: bytes, line_feed: bytes, kinds: tuple[int, ...]):
    """Lines of each split as bytes; of lines across splits the stretch in each, its cut at the end included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start, size, at, owner), pieces in by_split(batches):
            own, out, rest, head = [], [], owner >= 0, at == 0
            if head and size == len(mark) and (pieces := list(pieces)) == [mark]:
                pieces = []  # a mark and nothing else: no line

            def told(value: bytes, kind: int, key: int, file=file, start=start, out=out) -> None:
                if kind in kinds:
                    out.append((file, start, value, kind, key))

            for piece in pieces:
                piece = bytes(piece)
                at += len(piece)
                aligned = at % width == 0
                at += len(line_feed)
                own.append(piece.removeprefix(mark) if head else piece)
                head = False
                if aligned:
                    told(b"".join(own), REST if rest else RECORD, int(owner) if rest else start)
                    own, rest = [], False
                else:
                    own.append(line_feed)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["file", "start", "value", "kind", "owner"])
                    out.clear()
            if own:
                told(b"".join(own), REST if rest else HEAD, int(owner) if rest else start)
            yield pd.DataFrame(out, columns=["file", "start", "value", "kind", "owner"])

    return run


def _decoded(encoding: str, strict: bool):
    """Bytes up to a line feed to lines: carriage returns end lines as well, or belong to the line feed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, start, value in zip(batch["file"], batch["start"], batch["value"], strict=True):
                try:
                    own = bytes(value).decode(encoding, "strict" if strict else "replace").split("\r")
                except UnicodeDecodeError as e:
                    raise StreamError(f"the text is not {encoding} ({file})") from e
                out += [(file, start, line) for line in (own[:-1] if len(own) > 1 and not own[-1] else own)]
            yield pd.DataFrame(out, columns=["file", "start", "value"])

    return run


def wide_lines(spark: SparkSession, held: SparkSession, files: list[str], encoding: str, strict: bool = True) -> DataFrame:
    """(file, start, value) of the files in order, read by `held`, a session of a frozen split plan. encoding: with its byte
    order. The mark at a file's beginning goes. Text that is not of the encoding is an error, or replaced unless strict."""
    line_feed, mark = "\n".encode(encoding), "﻿".encode(encoding)
    width = len(line_feed)
    rows = held.read.option("lineSep", line_feed.decode("latin-1")).option("encoding", "ISO-8859-1").text(files)
    pieces = rows.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
    told = pieces.mapInPandas(_counted(width, width), "file string, start long, bytes long, aligned binary").collect()  # one row a split
    states = _states(told, width, width)
    met = with_splits(spark, pieces, states, "at long, owner long").select("piece", "file", "start", "size", "at", "owner")
    out = "file string, start long, value binary, kind int, owner long"
    lines = met.mapInPandas(_joined(width, mark, line_feed, (RECORD, HEAD)), out).drop("owner")
    if any(owner >= 0 for *_, owner in states):
        path = new_path(spark, "pieces")
        parts = met.mapInPandas(_joined(width, mark, line_feed, (HEAD, REST)), out)
        ordered = F.sort_array(F.collect_list(F.struct("start", "value")))
        whole = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["value"]))
        parts.groupBy("file", "owner").agg(whole.alias("complete")).write.parquet(path)
        complete = spark.read.parquet(path).withColumnRenamed("owner", "start").withColumn("kind", F.lit(HEAD))
        lines = in_place(spark, lines, complete).withColumn("value", F.coalesce("complete", "value")).drop("complete")
    return lines.mapInPandas(_decoded(encoding, strict), "file string, start long, value string")


def in_place(spark: SparkSession, rows: DataFrame, complete: DataFrame) -> DataFrame:
    """rows (file, start, kind, ...), in their order, with what `complete` has of those that lie across splits: one at most
    of a split, met in a shuffle after which splits lie whole and in order again."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.withColumn("__mid", F.monotonically_increasing_id()).join(complete.hint("merge"), ["file", "start", "kind"], "left")
    return met.repartition(parts, "file", "start").sortWithinPartitions("file", "start", "__mid").drop("__mid", "kind")


def heads(held: SparkSession, files: list[str]) -> DataFrame:
    """(file, head): the first bytes of each file that has any."""
    rows = held.read.option("lineSep", "\n").text(files).where(F.col("_metadata.file_block_start") == 0)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.substring(F.col("value").cast("binary"), 1, 4).alias("head"), F.monotonically_increasing_id().alias("mid"))
    return rows.groupBy("file").agg(F.min_by("head", "mid").alias("head"))


def by_encoding(files: list[str], found: list, encoding: str | None, plain: Callable[[str], str]) -> dict[str | None, list[str]]:
    """Files by their encoding with its byte order; those of 8 bits a character under None. found: (file, head)."""
    head = {plain(r["file"]): bytes(r["head"]) for r in found}
    out: dict[str | None, list[str]] = {}
    for f in files:
        own = head.get(plain(f), b"")
        known = order_of(encoding, own) if encoding else next((o for mark, o in ORDERS.items() if own.startswith(mark)), None)
        out.setdefault(known, []).append(f)
    return out
