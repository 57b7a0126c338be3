"""Framed records: 4 bytes of magic, 4 of kind and length (little-endian), the payload, padding to 4 bytes.

Files are read wherever Spark splits them: its text source cuts them at the magic, and every byte between two magics is
a piece of the split in which it begins. Where each piece is as long as its header says, it is a frame and stays in the
JVM. A file in which that does not hold (split records, a magic within a payload) is cut by the chain of lengths: a
frame takes pieces until its length is reached. What a split owes to the splits before it, bytes of a frame, is proven in
rounds: each split is read as if it began with a frame; the driver composes what they leave in order, one row a split,
and only splits that turn out to begin within a frame are read again, now with the bytes that are missing. Records
that lie across splits are put together from their pieces, which alone are shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import CorruptHeaderError, CorruptRecordError, RecordError

from .lines import Numbered, frozen, number_rows
from .quoted import HEAD, RECORD, REST, by_split, with_splits
from .staging import new_path
from .stores import compression_of, contents, name_of, numbered, special

#: Fixed values of the format.
MAGIC = 0xCED7230A
COMPLETE, BEGIN, MIDDLE, END = range(4)

SEPARATOR = MAGIC.to_bytes(4, "little")


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if len(data) - at < 8 or struct.unpack_from("<I", data, at)[0] != MAGIC:
            raise CorruptHeaderError(f"no record header at byte {at}")
        word = struct.unpack_from("<I", data, at + 4)[0]
        kind, length = word >> 29, word & 0x1FFFFFFF
        if at + 8 + length > len(data):
            raise CorruptHeaderError(f"the record at byte {at} is cut off")
        yield kind, data[at + 8 : at + 8 + length]
        at += 8 + length + (-length % 4)


def records(data: bytes) -> Iterator[bytes]:
    """Payloads, split records put together."""
    open_: list[bytes] | None = None
    for n, (kind, payload) in enumerate(frames(data)):
        if kind in (COMPLETE, BEGIN) if open_ is not None else kind in (MIDDLE, END):
            raise CorruptRecordError(f"The record #{n} in the data store is out of order")
        if kind == COMPLETE:
            yield payload
            continue
        open_ = [*(open_ or []), payload]
        if kind == END:
            yield b"".join(open_)
            open_ = None
    if open_ is not None:
        raise CorruptRecordError("the last split record does not end")


def framed(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Payloads of a byte stream as it comes; what is held is one record and a part."""
    rest, held = bytearray(), bytearray()
    for part in parts:
        rest += part
        at = 0
        while len(rest) - at >= 8:
            magic, word = struct.unpack_from("<II", rest, at)
            if magic != MAGIC:
                raise CorruptHeaderError("a record of the stream has no header")
            length = word & 0x1FFFFFFF
            end = at + 8 + length + (-length % 4)
            if end > len(rest):
                break
            held += rest[at:end]
            at = end
            if word >> 29 in (COMPLETE, END):
                yield from records(bytes(held))
                held.clear()
        del rest[:at]
    if held or rest:
        yield from records(bytes(held + rest))


def read_records(spark: SparkSession, stores: list) -> DataFrame:
    """(__row_idx, payload, __store_idx, __pos) of the records of the stores in order.

    Stores that Spark does not read by itself are a row of the scan each; files are cut split by split, as the module
    says. An empty file has no records. Errors name the store.
    """
    if not special(stores):
        return _by_ranges(spark, stores).lines().withColumnRenamed("value", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    own = list(records(bytes(content)))
                except RecordError as e:
                    raise type(e)(f"{e} ({path})") from e
                yield pd.DataFrame({"path": path, "__row_idx": range(len(own)), "payload": own})

    return numbered(contents(spark, stores).mapInPandas(run, "path string, __row_idx long, payload binary"), stores).drop("path")


def _by_ranges(spark: SparkSession, stores: list) -> Numbered:
    """Payloads of files, numbered: those of plain files cut in the JVM, those of others along the chain."""
    files = list(dict.fromkeys(map(name_of, stores)))
    rows = frozen(spark).read.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(files)
    rows = rows.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
    word = F.conv(F.hex(F.concat(*(F.substring("piece", k, 1) for k in (4, 3, 2, 1)))), 16, 10).cast("long")
    kind, length = F.shiftright(word, 29), word.bitwiseAND(0x1FFFFFFF)
    before = F.octet_length("piece") == 0  # what stands before the first magic
    whole = (kind == COMPLETE) & (F.octet_length("piece") == 4 + length + F.pmod(-length, F.lit(4)))
    told = rows.select("file", "start", "piece", before.alias("before"), F.coalesce(whole, F.lit(False)).alias("whole"), F.substring("piece", F.lit(5), length.cast("int")).alias("value"))
    by_file = told.groupBy("file").agg((F.count_if(~F.col("before") & ~F.col("whole")) > 0).alias("odd"), F.count_if(F.col("before") & (F.col("start") == 0)).alias("heads"), F.count_if(F.col("before")).alias("empty"))
    odd = [r["file"] for r in by_file.where("odd or heads <> 1 or empty <> 1").collect()]  # of the list of files
    plain = told.where("not before").select("file", "start", "value")
    if not odd:
        return number_rows(spark, stores, plain)
    chained, completed = cut_chains(spark, rows.where(F.col("file").isin(odd)).select("piece", "file", "start", "size"))
    both = plain.where(~F.col("file").isin(odd)).withColumn("kind", F.lit(RECORD)).unionByName(chained)
    own = number_rows(spark, stores, both)
    return replace(own, rows=completed(own.rows))


@dataclass
class Chain:
    """Pieces to records along the lengths of frames. missing: bytes of the open frame, that are yet to come; open: whether a
    split record is; frames: so many stand before."""

    missing: int = 0
    open: bool = False
    frames: int = 0
    first: bool = False  # the next piece is what stands before the first magic of a file
    strict: bool = True  # order of split records is checked

    def __post_init__(self):
        self.kind, self.parts, self.own, self.length = COMPLETE, [], [], 0

    def feed(self, piece: bytes) -> bytes | None:
        """The record that ends with this piece, if one does."""
        if self.first:
            self.first = False
            if piece:
                raise CorruptHeaderError("no record header at byte 0")
            return None
        if self.missing:
            if len(piece) + 4 > self.missing:
                raise CorruptHeaderError(f"no record header after the record #{self.frames}")
            self.parts += [SEPARATOR, piece]
            self.missing -= len(piece) + 4
        else:
            word = struct.unpack_from("<I", piece + SEPARATOR)[0]  # a magic may begin within the header
            self.kind, self.length = word >> 29, word & 0x1FFFFFFF
            self.missing = 4 + self.length + (-self.length % 4) - len(piece)
            if self.missing < 0:
                raise CorruptHeaderError(f"no record header after the record #{self.frames}")
            if self.strict and (self.kind in (COMPLETE, BEGIN) if self.open else self.kind in (MIDDLE, END)):
                raise CorruptRecordError(f"The record #{self.frames} in the data store is out of order")
            self.parts = [piece]
        return self._ended() if not self.missing else None

    def _ended(self) -> bytes | None:
        self.own.append(b"".join(self.parts)[4 : 4 + self.length] if self.length >= 0 else b"")  # of a frame that began before, nothing
        self.parts = []
        self.frames += 1
        self.open = self.kind in (BEGIN, MIDDLE)
        if self.open:
            return None
        record, self.own = b"".join(self.own), []
        return record


#: Of a split: how it was entered, whether the chain holds, bytes missing at its end, its bytes and those of its file; of the
#: frames that begin in it their number, whether any begins a record, and the last one's kind.
SUMMARY = "file string, start long, missing long, ok boolean, left long, bytes long, size long, frames long, begins boolean, kind int"
COLUMNS = [c.split()[0] for c in SUMMARY.split(", ")]


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each split is, if it begins with `missing` bytes of a frame."""
    for (file, start, size, missing), pieces in by_split(batches):
        walk = Chain(int(missing), first=start == 0, strict=False)
        n, begins, kind, ok, length = 0, False, COMPLETE, True, 0
        for piece in pieces:
            length += len(piece) + (0 if walk.first else 4)
            fresh = ok and not walk.missing and not walk.first
            try:
                if ok:
                    walk.feed(bytes(piece))
            except RecordError:
                ok = False
            walk.own.clear()
            walk.parts = []
            if fresh and ok:
                n, kind = n + 1, walk.kind
                begins |= kind in (COMPLETE, BEGIN)
        yield pd.DataFrame([(file, start, missing, ok, walk.missing, length, size, n, begins, kind)], columns=COLUMNS)


def _within(missing: int, kind: int) -> bool:
    """Whether a record is open: bytes of a frame are missing, or the frame that ended last was not the record's last."""
    return missing > 0 or kind in (BEGIN, MIDDLE)


def _compose(told: dict[tuple[str, int], dict]) -> tuple[dict, dict]:
    """(state of each split at its beginning, splits to be read again with the bytes that are missing there). A state: bytes
    missing, kind of the last frame, frames before, and the split where the open record began, or -1. What follows a
    split that is to be read again is as good as guessed, and composed anew then."""
    states, again, file = {}, {}, None
    for key in sorted(told):
        if key[0] != file:
            file, missing, kind, frames, owner, proven = key[0], 0, COMPLETE, 0, -1, True
        s = told[key]
        if s["missing"] != missing and proven:
            again[key], proven = missing, False
        states[key] = (missing, kind, frames, owner)
        if not s["ok"]:  # damage, or a guess that was wrong
            missing, kind, owner = 0, COMPLETE, -1
            continue
        frames, missing = frames + s["frames"], s["left"]
        kind = s["kind"] if s["frames"] else kind
        owner = -1 if not _within(missing, kind) else key[1] if s["begins"] else owner
    return states, again


def cut_chains(spark: SparkSession, pieces: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """pieces (piece, file, start, size) of a frozen read to (file, start, value, kind) and a function that completes the values
    of kind HEAD."""
    entries = pieces.withColumn("missing", F.lit(0).cast("long"))
    told: dict[tuple[str, int], dict] = {}
    while True:  # each round proves one more split at least
        told |= {(s["file"], s["start"]): s for s in (r.asDict() for r in entries.mapInPandas(_summary, SUMMARY).collect())}  # one row a split
        states, again = _compose(told)
        if not again:
            break
        entries = with_splits(spark, pieces, [(*k, m) for k, m in again.items()], "missing long").select("piece", "file", "start", "size", "missing")
    lasts = {file: start for file, start in sorted(told)}
    length: dict[str, int] = {}
    for (file, _), s in told.items():
        length[file] = length.get(file, 0) + s["bytes"]
    table = []
    for key, state in states.items():
        last = lasts[key[0]] == key[1]
        # Spark drops the empty piece after a magic at the very end; sizes of packed files do not tell
        ends = last and (told[key]["size"] - length[key[0]] == 4 or compression_of(key[0]) is not None and told[key]["left"] == 4)
        table.append((*key, *state, last, ends))
    met = with_splits(spark, pieces, table, "missing long, open_kind int, frames long, owner long, last boolean, ends boolean")
    met = met.select("piece", "file", "start", "missing", "open_kind", "frames", "owner", "last", "ends")
    out = "file string, start long, value binary, kind int, owner long"
    cut = met.mapInPandas(_chained((RECORD, HEAD)), out).drop("owner")
    if all(owner < 0 for *_, owner in states.values()):
        return cut, lambda df: df
    path = new_path(spark, "pieces")
    parts = met.mapInPandas(_chained((HEAD, REST)), out)
    joined = F.sort_array(F.collect_list(F.struct("start", "value")))
    whole = F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["value"]))
    parts.groupBy("file", "owner").agg(whole.alias("complete")).mapInPandas(_trimmed, "file string, owner long, complete binary").write.parquet(path)
    held = spark.read.parquet(path).withColumnRenamed("owner", "start").withColumn("kind", F.lit(HEAD))

    def completed(df: DataFrame) -> DataFrame:
        return df.join(held, ["file", "start", "kind"], "left").withColumn("value", F.coalesce("complete", "value")).drop("complete")

    return cut, completed


def _trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of a record, as they stand in the file, to its payload."""
    for batch in batches:
        payload = [b"".join(p for _, p in frames(bytes(data))) for data in batch["complete"]]
        yield pd.DataFrame({"file": batch["file"], "owner": batch["owner"], "complete": payload})


def _chained(kinds: tuple[int, ...]):
    """Records of each split, whose state at its beginning is known. What lies across splits is given as bytes of the file:
    its beginning (HEAD) where it begins, each further stretch (REST) where that lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start, missing, open_kind, before, owner, last, ends), pieces in by_split(batches):
            walk = Chain(int(missing), open_kind in (BEGIN, MIDDLE), int(before), first=start == 0)
            walk.kind, walk.length = int(open_kind), -1
            raw, rest, out = [], owner >= 0, []

            def told(value: bytes, kind: int, at: int, file=file, start=start, out=out) -> None:
                if kind in kinds:
                    out.append((file, start, value, kind, at))

            for piece in chain(map(bytes, pieces), [b""] if ends else []):
                started = not walk.first
                try:
                    record = walk.feed(piece)
                except RecordError as e:
                    raise type(e)(f"{e} ({file})") from e
                if started:
                    raw += [SEPARATOR, piece]
                if record is not None:
                    told(b"".join(raw) if rest else record, REST if rest else RECORD, int(owner) if rest else start)
                    rest, raw = False, []
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["file", "start", "value", "kind", "owner"])
                    out.clear()
            if raw:
                if last and walk.missing:
                    raise CorruptHeaderError(f"the record #{walk.frames} is cut off ({file})")
                if last:
                    raise CorruptRecordError(f"the last split record does not end ({file})")
                told(b"".join(raw), REST if rest else HEAD, int(owner) if rest else start)
            elif last and rest:
                raise CorruptHeaderError(f"the record #{walk.frames} is cut off ({file})")
            yield pd.DataFrame(out, columns=["file", "start", "value", "kind", "owner"])

    return run
