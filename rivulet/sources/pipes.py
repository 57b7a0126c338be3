"""Named pipes: each pass over the data reads the next pipe, PATH_0, PATH_1 and so on, to its end.

A pipe is one stream that can be read once, on the machine that holds it: one partition, and a lost task cannot be
repeated, which is an error rather than a stream without its beginning. `spool` brings a pipe into a file of the shared
folder, byte by byte as it comes; what reads that file is split and repeated like any other.
"""

from __future__ import annotations

import os
import select
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rivulet.errors import InflateError, NotSupportedError, StreamError

from .staging import discard, new_path
from .stores import check_compression, list_objects, put

#: Bytes asked of a pipe at a time.
READ = 1 << 20
#: Times a pipe is opened before that is an error, and seconds between them.
ATTEMPTS, BETWEEN = 3, 1.0


def _open(path: str) -> int:
    """A pipe may be made while we come to read it."""
    for left in reversed(range(ATTEMPTS)):
        try:
            return os.open(path, os.O_RDONLY | os.O_NONBLOCK | os.O_CLOEXEC)
        except OSError as e:
            if not left:
                raise StreamError(f"the pipe {path} cannot be opened") from e
            time.sleep(BETWEEN)
    raise AssertionError


def inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """gzip or zlib, members one after the other."""
    stream = None
    for part in parts:
        while part:
            stream = stream or zlib.decompressobj(32 + zlib.MAX_WBITS)
            try:
                yield stream.decompress(part)
            except zlib.error as e:
                raise InflateError("the stream does not inflate") from e
            part, stream = stream.unused_data, None if stream.eof else stream
    if stream is not None:
        raise InflateError("the stream is cut off")


def chunks(path: str, timeout: float) -> Iterator[bytes]:
    """What comes out of the pipe until its writer closes it; StreamError where nothing comes for timeout seconds."""
    fd = _open(path)
    began, seen = time.monotonic(), False
    try:
        while True:
            if not select.select([fd], [], [], timeout)[0]:
                raise StreamError(f"nothing came out of the pipe {path} for {timeout} seconds")
            try:
                data = os.read(fd, READ)
            except BlockingIOError:
                continue
            if data:
                seen = True
                yield data
            elif seen:
                return
            elif time.monotonic() - began > timeout:  # no writer has come yet
                raise StreamError(f"nothing came out of the pipe {path} for {timeout} seconds")
            else:
                time.sleep(0.01)
    finally:
        os.close(fd)


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of a byte stream; the last one may lack its end."""
    rest = b""
    for part in parts:
        whole = rest + part
        held = whole.endswith(b"\r")  # its line feed may follow
        own = whole.splitlines(keepends=True)
        rest = own.pop() if own and (held or not own[-1].endswith((b"\n", b"\r"))) else b""
        yield from own
    if rest:
        yield rest


@dataclass(frozen=True)
class PipeStore:
    """A pipe in a reader's list of stores: pass n of the reader reads PATH_n, beginning with fifo_id."""

    path: str
    timeout: float = 60.0
    fifo_id: int = 0
    compression: str = "none"

    def __post_init__(self):
        check_compression(self.compression)
        if self.compression == "infer":
            raise NotSupportedError("the compression of a pipe cannot be inferred")


class _Reader(DataSourceReader):
    def __init__(self, path: str, timeout: float, compression: str, raw: bool):
        self.path, self.timeout, self.compression, self.raw = path, timeout, compression, raw

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        task = TaskContext.get()
        if task is not None and task.attemptNumber():
            raise StreamError(f"the pipe {self.path} was not read to its end by its first reader and cannot be read again")
        parts = chunks(self.path, self.timeout)
        parts = inflated(parts) if self.compression == "gzip" else parts
        if self.raw:
            for n, part in enumerate(parts):
                yield part, n
            return
        for n, line in enumerate(lines(parts)):
            yield line.rstrip(b"\r\n").decode("utf-8", "replace"), n


class PipeSource(DataSource):
    """Options: path, number (of the pass), timeout in seconds, compression, raw (bytes as they come, not lines)."""

    @classmethod
    def name(cls) -> str:
        return "pipe"

    @property
    def _raw(self) -> bool:
        return self.options.get("raw", "false").lower() == "true"

    def schema(self) -> str:
        return f"value {'binary' if self._raw else 'string'}, __pos long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(f"{self.options['path']}_{self.options.get('number', '0')}", float(self.options.get("timeout", "60")), self.options.get("compression", "none"), self._raw)


def read_pipe(spark: SparkSession, path: str, number: int = 0, timeout: float = 60.0, compression: str = "none", raw: bool = False) -> DataFrame:
    """(value, __pos) of the lines of the pipe of that pass; raw: of its bytes, as they came."""
    spark.dataSource.register(PipeSource)
    return spark.read.format("pipe").option("path", path).option("number", number).option("timeout", timeout).option("compression", compression).option("raw", raw).load()


def spool(spark: SparkSession, store: PipeStore, number: int = 0) -> str:
    """Reads the pipe of a pass to its end, once, and gives a file of the shared folder with its bytes, inflated.

    The bytes are first written as they come, so only that step cannot be repeated. A task then joins them to a file: the
    text writer sets a line end after each row, which is the stream's last byte, and rows are cut after such bytes.
    """
    came, path = new_path(spark, "came"), new_path(spark, "pipe")
    read_pipe(spark, store.path, store.fifo_id + number, store.timeout, store.compression, raw=True).write.parquet(came)
    held = spark.read.parquet(came).where("octet_length(value) > 0")
    last = held.agg(F.max_by(F.substring("value", -1, 1), "__pos")).first()[0]
    if last is None:
        return put(spark, path, b"")
    end = bytes(last)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[bytes] = []
        for batch in batches:
            for value in map(bytes, batch["value"]):
                at = value.rfind(end)
                if at < 0:
                    rest.append(value)
                    continue
                yield pd.DataFrame({"value": [b"".join([*rest, value[:at]])]})
                rest = [value[at + 1 :]]

    rows = held.repartition(1).sortWithinPartitions("__pos").mapInPandas(cut, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    discard(came)
    (file,) = list_objects(spark, path, "*.txt")
    return file
