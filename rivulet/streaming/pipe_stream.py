"""A named pipe as a stream: lines, delimited rows or framed records as they come, and batches of them.

A pipe is one machine's stream: the driver's, which reads it to its end in micro-batches of bounded size. Tasks get a
micro-batch from Spark's blocks, so a lost executor loses nothing; the offset is the number of rows and whether the pipe
has ended. What was read is gone: a query that begins anywhere but where its pipe stands is an error, not a stream
without its beginning.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from rivulet.errors import NotSupportedError, StreamError
from rivulet.operators import rows
from rivulet.params import CsvParams, ReaderParams
from rivulet.readers import OWN, blank
from rivulet.schema import Schema
from rivulet.sources.csv import parse_rows
from rivulet.sources.pipes import PipeStore, chunks, inflated, lines
from rivulet.sources.protobuf import decode_messages
from rivulet.sources.recordio import framed
from rivulet.sources.staging import new_path

#: Bytes of a micro-batch beyond which it ends, and seconds after which it ends in any case.
MOST_BYTES, MOST_SECONDS = 16 << 20, 1.0


class _Reader(SimpleDataSourceStreamReader):
    """Micro-batches end where the rows after `first` are a multiple of `multiple`, or with the pipe."""

    def __init__(self, options: dict[str, str]):
        own = lambda key, other: options.get(key, other)
        self.path, self.timeout = f"{options['path']}_{own('number', '0')}", float(own("timeout", "60"))
        self.gzip, self.records = own("compression", "none") == "gzip", own("kind", "lines") == "records"
        self.head, self.comment, self.blank = int(own("head", "0")), own("comment", ""), own("blank", "false") == "true"
        self.first, self.multiple, self.most = int(own("first", "0")), int(own("multiple", "1")), int(own("most", str(MOST_BYTES)))
        self.at, self.rows = 0, None

    def _begin(self) -> Iterator[bytes | str]:
        parts = chunks(self.path, self.timeout)
        parts = inflated(parts) if self.gzip else parts
        if self.records:
            return framed(parts)
        text = (line.rstrip(b"\r\n").decode("utf-8", "replace") for line in lines(parts))
        kept = (t for t in text if not (self.comment and t.startswith(self.comment)) and not (self.blank and not t))
        return islice(kept, self.head, None)

    def initialOffset(self) -> dict:
        return {"row": 0, "ended": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["ended"]:
            return iter(()), start
        if start["row"] != self.at:
            raise StreamError(f"the pipe {self.path} stands at row {self.at} and cannot be read from row {start['row']} on")
        self.rows = self._begin() if self.rows is None else self.rows
        held, size, began, ended = [], 0, time.monotonic(), True
        for row in self.rows:
            held.append((row, self.at))
            self.at += 1
            size += len(row)
            if (self.at - self.first) % self.multiple == 0 and self.at >= self.first and (size >= self.most or time.monotonic() - began > MOST_SECONDS):
                ended = False
                break
        return iter(held), {"row": self.at, "ended": ended}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise StreamError(f"the rows {start['row']} to {end['row']} of the pipe {self.path} were read before and cannot be read again")


class PipeStreamSource(DataSource):
    """Options: path, number (of the pass), timeout in seconds, compression, kind (lines or records), head (lines to leave
    out at the beginning), comment, blank (leave out empty lines), first and multiple (where micro-batches may end), most
    (bytes of one)."""

    @classmethod
    def name(cls) -> str:
        return "pipe_stream"

    def schema(self) -> str:
        return "payload binary, __pos long" if self.options.get("kind", "lines") == "records" else "value string, __pos long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


def stream_pipe(spark: SparkSession, store: PipeStore, number: int = 0, **options) -> DataFrame:
    """A stream of (value or payload, __pos) of the pipe of that pass; options are those of the source."""
    spark.dataSource.register(PipeStreamSource)
    told = {"path": store.path, "number": store.fifo_id + number, "timeout": store.timeout, "compression": store.compression, **options}
    return spark.readStream.format("pipe_stream").options(**told).load()


def stream_csv(spark: SparkSession, store: PipeStore, params: CsvParams, number: int = 0, **options) -> DataFrame:
    """A stream of delimited rows, as the reader of files has them. Columns need names, as nothing is read before the
    stream begins; types that are not given are text."""
    if not params.column_names:
        raise NotSupportedError("a stream of delimited rows needs column_names")
    if params.allow_quoted_new_lines or params.encoding or params.compression:
        raise NotSupportedError("a stream takes neither quoted line ends nor an encoding; compression is the pipe's")
    head = 0 if params.header_row_index is None else params.header_row_index + 1
    own = {"head": head, "comment": params.comment_char or "", "blank": params.skip_blank_lines}
    data = stream_pipe(spark, store, number, **own, **options)
    return parse_rows(data.withColumns({"__store_idx": F.lit(0), "__row_idx": F.col(rows.POS)}), params)


def stream_messages(spark: SparkSession, store: PipeStore, schema: Schema, number: int = 0, **options) -> DataFrame:
    """A stream of tensors, of framed messages of a schema that is known before."""
    data = stream_pipe(spark, store, number, kind="records", **options)
    extra = {"__store_idx": F.lit(0), "__row_idx": F.col(rows.POS), "__bytes": F.octet_length("payload")}
    return decode_messages(data.withColumns(extra), schema)


def stream_batches(
    spark: SparkSession, store: PipeStore, write: Callable[[DataFrame, int], None], params: ReaderParams | None = None,
    csv_params: CsvParams | None = None, schema: Schema | None = None, number: int = 0, most: int = MOST_BYTES, **trigger,
) -> StreamingQuery:
    """Starts a query that gives `write` the batches of each micro-batch (one row a batch, as the readers' batches()) and
    its number. Rows are lines, delimited rows (csv_params) or messages (schema).

    Batches are those of a reader of a file with the same bytes: a micro-batch ends between two batches of the shard.
    Samples and shuffles, which look beyond a micro-batch, are errors. A micro-batch may be without batches.
    """
    p = params or ReaderParams()
    if p.sample_ratio is not None or p.shuffle_instances:
        raise NotSupportedError("a stream takes no samples and no shuffles")
    ends = {"first": p.num_instances_to_skip, "multiple": p.batch_size * max(1, p.num_shards), "most": most}
    if csv_params is not None:
        data = stream_csv(spark, store, csv_params, number, **ends)
    elif schema is not None:
        data = stream_messages(spark, store, schema, number, **ends)
    else:
        data = stream_pipe(spark, store, number, **ends).withColumn("__bad", F.lit(None).cast("string"))
    padding = {f.name: blank(f.dataType, tuple(f.metadata.get("shape", ()))) for f in data.schema if f.name not in OWN}

    def each(micro: DataFrame, n: int) -> None:
        kept = rows.chain(micro, p)
        write(rows.batches(kept, padding, p.batch_size, p.last_example_handling, F.col("__bad"), p.bad_example_handling), n)

    out = data.writeStream.foreachBatch(each).option("checkpointLocation", new_path(spark, "stream"))
    return (out.trigger(**trigger) if trigger else out).start()
