"""Records whose quoted fields hold line ends, cut split by split.

Whether a split begins within a quoted field depends on all text before it. A first pass tells for each split, for
either beginning, how it ends: one row a split, composed in order on the driver. With the beginnings known, splits are
cut side by side; a record that lies across splits is put together from its pieces, which alone are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import CorruptRecordError

from .staging import new_path
from .stores import BROADCAST_BYTES, local_table

LINE_END = "\r\n|\r|\n"
#: Kinds of what a split yields: a record, the beginning of one that goes on in the next split, and what goes on.
RECORD, HEAD, REST = range(3)


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    comment: str | None = None


def _stays_open(line: str, delimiter: str, quote: str, inside: bool) -> bool:
    """Whether a line ends within a quoted field; inside: it begins within one."""
    if not inside and quote not in line:
        return False
    at, n = 0, len(line)
    while True:
        if not inside and at < n and line[at] == quote:
            at, inside = at + 1, True
        if inside:
            while (end := line.find(quote, at)) >= 0 and line[end + 1 : end + 2] == quote:
                at = end + 2
            if end < 0:
                return True
            at, inside = end + 1, False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


class Machine:
    """Lines to records: a line end within a quoted field is part of the record."""

    def __init__(self, dialect: Dialect, inside: bool = False):
        self.dialect, self.inside, self.own, self.ended = dialect, inside, [], False

    def feed(self, line: str, end: str) -> str | None:
        """The record that ends with this line, if one does. end: the line's end, empty at the end of a text."""
        d = self.dialect
        self.own.append(line)
        if self.inside or not (d.comment and line.startswith(d.comment)):
            self.inside = _stays_open(line, d.delimiter, d.quote, self.inside)
        if self.inside and end:
            self.own.append(end)
        elif end or self.own != [""]:
            record, self.own, self.ended = "".join(self.own), [], True
            return record
        return None


def lines_of(text: str) -> Iterator[tuple[str, str]]:
    """(line, its end); the last end is empty."""
    pieces = re.split(f"({LINE_END})", text)
    yield from zip(pieces[::2], [*pieces[1::2], ""], strict=True)


def lines_within(text: str) -> Iterator[tuple[str, str]]:
    """(line, its end) of a text that holds no line feed and ends before one."""
    if "\r" not in text:
        yield text, "\n"
        return
    for line, end in lines_of(text + "\n"):
        if end or line:
            yield line, end


def quoted_records(dialect: Dialect = Dialect(), tokenize: Callable[[str, str, str], list[str]] | None = None) -> Callable[[str], list[str]]:
    """A function from a text to its records, which carries the dialect and what cuts a record into fields, if given."""

    def cut(text: str) -> list[str]:
        machine = Machine(dialect)
        return [r for line, end in lines_of(text) if (r := machine.feed(line, end)) is not None]

    cut.dialect, cut.tokenize = dialect, tokenize
    return cut


def by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, start, ...), lines) of each stretch of rows of one split; a stretch is read to its end before the next."""
    rows = (r for b in batches for r in b.itertuples(index=False, name=None))  # (value, file, start, ...)
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[1:]

        def own(key: tuple = key) -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[1:] == key:
                yield ahead[0]
                ahead = next(rows, None)

        lines = own()
        yield key, lines
        for _ in lines:
            pass


def _ends(dialect: Dialect):
    """For either beginning of each split, whether it ends within a quoted field, and whether a record ended in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, lines in by_split(batches):
            machines, marked = [Machine(dialect, inside) for inside in (False, True)], False
            for text in lines:
                marked |= text is None
                if marked:
                    continue
                for line, end in lines_within(text):
                    for m in machines:
                        m.feed(line, end)
                        m.own.clear()
            out, within = machines
            yield pd.DataFrame([(*key, marked, out.inside, out.ended, within.inside, within.ended)], columns=["file", "start", "marked", "out_open", "out_ended", "in_open", "in_ended"])

    return run


PIECE = "file string, start long, value string, kind int, owner long"
#: Fields of a record that holds a quote, null for others, or why there are none.
FIELDS = "fields array<string>, unread string"


def _fields(dialect: Dialect, tokenize: Callable, record: str) -> tuple[list[str] | None, str | None]:
    if not dialect.quote or dialect.quote not in record:
        return None, None
    try:
        return tokenize(record, dialect.delimiter, dialect.quote), None
    except CorruptRecordError as e:
        return None, str(e)


def _pieces(dialect: Dialect, kinds: tuple[int, ...], tokenize: Callable | None = None):
    """PIECE, and FIELDS where records are cut in the same process."""
    columns = ["file", "start", "value", "kind", "owner", *(["fields", "unread"] if tokenize else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start, inside, owner), lines in by_split(batches):
            machine, rest, held = Machine(dialect, bool(inside)), bool(inside), []

            def told(value: str, kind: int, at: int, file=file, start=start, held=held) -> None:
                if kind in kinds:
                    held.append((file, start, value, kind, at, *(_fields(dialect, tokenize, value) if tokenize else ())))

            for text in lines:
                for line, end in lines_within(text):
                    if (record := machine.feed(line, end)) is not None:
                        told(record, REST if rest else RECORD, int(owner) if rest else start)
                        rest = False
                if len(held) >= 10_000:
                    yield pd.DataFrame(held, columns=columns)
                    held.clear()
            if machine.own:
                told("".join(machine.own), REST if rest else HEAD, int(owner) if rest else start)
            yield pd.DataFrame(held, columns=columns)

    return run


def _with_fields(dialect: Dialect, tokenize: Callable):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [_fields(dialect, tokenize, record) for record in batch["complete"]]
            yield pd.concat([batch, pd.DataFrame(told, columns=["own_fields", "own_unread"], index=batch.index)], axis=1)

    return run


def with_splits(spark: SparkSession, rows: DataFrame, table: list[tuple], columns: str) -> DataFrame:
    """rows (file, start, ...) of a frozen read, in their order, with what `table` (file, start, columns) has of their split.
    A table beyond BROADCAST_BYTES meets them in a shuffle, after which splits lie whole and in order again."""
    held = local_table(spark, table, f"file string, start long, {columns}")
    if sum(len(t[0]) + 16 + 8 * len(t) for t in table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(held), ["file", "start"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.withColumn("__mid", F.monotonically_increasing_id()).join(held.hint("merge"), ["file", "start"])
    return met.repartition(parts, "file", "start").sortWithinPartitions("file", "start", "__mid").drop("__mid")


def cut_splits(spark: SparkSession, lines: DataFrame, dialect: Dialect, tokenize: Callable | None = None) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]] | None:
    """lines (value, file, start), cut at line feeds alone by a frozen read, to (file, start, value, kind), records in
    order, those that lie across splits at their beginning; the same rows with FIELDS, if they are to be tokenized; and
    a function that completes the values of records across splits. None if a value is null: text that cannot be cut so."""
    told = lines.mapInPandas(_ends(dialect), "file string, start long, marked boolean, out_open boolean, out_ended boolean, in_open boolean, in_ended boolean").collect()
    if any(s["marked"] for s in told):
        return None
    begins, last, inside, owner = [], None, False, -1
    for s in sorted(told, key=lambda s: (s["file"], s["start"])):
        if s["file"] != last:
            last, inside, owner = s["file"], False, -1
        begins.append((s["file"], s["start"], inside, owner))
        ends, ended = (s["in_open"], s["in_ended"]) if inside else (s["out_open"], s["out_ended"])
        owner = -1 if not ends else s["start"] if ended or not inside else owner
        inside = ends
    met = with_splits(spark, lines, begins, "inside boolean, owner long").select("value", "file", "start", "inside", "owner")
    records = met.mapInPandas(_pieces(dialect, (RECORD, HEAD)), PIECE).drop("owner")
    full = met.mapInPandas(_pieces(dialect, (RECORD, HEAD), tokenize), f"{PIECE}, {FIELDS}").drop("owner") if tokenize else records
    if not any(b[2] for b in begins):
        return records, full, lambda df: df
    path = new_path(spark, "pieces")
    parts = met.mapInPandas(_pieces(dialect, (HEAD, REST)), PIECE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "")
    joint = parts.groupBy("file", "owner").agg(text.alias("complete"))
    if tokenize:
        joint = joint.mapInPandas(_with_fields(dialect, tokenize), "file string, owner long, complete string, own_fields array<string>, own_unread string")
    joint.write.parquet(path)
    whole = spark.read.parquet(path).withColumnRenamed("owner", "start").withColumn("kind", F.lit(HEAD))

    def completed(df: DataFrame) -> DataFrame:
        joined = df.join(whole, ["file", "start", "kind"], "left")
        if tokenize:
            own = F.col("complete").isNotNull()
            joined = joined.withColumns({c: F.when(own, F.col(f"own_{c}")).otherwise(F.col(c)) for c in ("fields", "unread")}).drop("own_fields", "own_unread")
        return joined.withColumn("value", F.coalesce("complete", "value")).drop("complete")

    return records, full, completed
