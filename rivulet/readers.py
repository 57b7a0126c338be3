"""Readers: files in order through the row operators to batches, as DataFrames or one by one.

    reader = CsvReader(spark, list_files("data", "*.csv"), ReaderParams(batch_size=64, shuffle_instances=True))
    reader.batches()               # a DataFrame, one row a batch
    for example in reader: ...     # batch after batch on the driver
    reader.reset()                 # the next epoch
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from rivulet.errors import InvalidInstanceError, NotSupportedError, translated
from rivulet.log import logger
from rivulet.operators import rows
from rivulet.params import CsvParams, MaxFieldLengthHandling, ReaderParams
from rivulet.schema import Schema
from rivulet.sources import csv, images, lines, pipes, protobuf
from rivulet.sources.stores import check_compression
from rivulet.streaming.examples import Example, Ordered

#: Columns that are not features.
OWN = ("__store_idx", "__row_idx", rows.POS, "__bad", "__bytes", "__note")


def blank(kind: DataType, shape: tuple[int, ...] = ()) -> Column:
    """What pads a batch: zeros, empty text, no entries."""
    if isinstance(kind, StringType):
        return F.lit("")
    if isinstance(kind, ArrayType):
        return F.array_repeat(F.lit(0), math.prod(shape)).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*(F.array().cast(f.dataType).alias(f.name) for f in kind))
    return F.lit(0).cast(kind)


class DataReader:
    """A reader over source(), a DataFrame with __pos (from 0, without gaps) and __bad (null, or why a row does not
    decode). The schema is that of the rows before they are shuffled."""

    #: Whether the source can be read only once.
    _once = False

    def __init__(self, spark: SparkSession, paths: list, params: ReaderParams | None = None):
        self.spark, self.paths, self.params = spark, list(paths), params or ReaderParams()
        seed = self.params.shuffle_seed
        self._seed = random.randrange(1 << 31) if seed is None else seed
        self.epoch = 0
        self._made: tuple[int, DataFrame] | None = None
        self._begin()

    def source(self) -> DataFrame:
        raise NotImplementedError

    @property
    def _source(self) -> DataFrame:
        """Of one pass where stores are pipes, each of which is read once a pass; of all passes otherwise."""
        own = self.epoch if any(isinstance(p, pipes.PipeStore) for p in self.paths) else 0
        if self._made is None or self._made[0] != own:
            self._made = own, self.source()
        return self._made[1]

    def stores(self) -> list:
        """The stores of this pass: pipes are brought into files."""
        return [pipes.spool(self.spark, p, self.epoch) if isinstance(p, pipes.PipeStore) else p for p in self.paths]

    def padding(self) -> dict[str, Column]:
        """The features, and what pads each."""
        return {f.name: blank(f.dataType, tuple(f.metadata.get("shape", ()))) for f in self.read_schema()}

    def read_schema(self) -> StructType:
        return StructType([f for f in self._source.schema if f.name not in OWN])

    def rows(self, epoch: int = 0) -> DataFrame:
        """The rows that the parameters leave, with their place in the epoch as __pos."""
        df = rows.chain(self._source, self.params)
        if self.params.shuffle_instances:
            df = rows.shuffled(df, self._seed, self.params.shuffle_window, epoch, self.params.reshuffle_each_epoch, once=self._once)
        return df

    def _batches(self, epoch: int, details: bool) -> DataFrame:
        p = self.params
        return rows.batches(self.rows(epoch), self.padding(), p.batch_size, p.last_example_handling, F.col("__bad"), p.bad_example_handling, details=details)

    def batches(self, epoch: int = 0) -> DataFrame:
        """One row per batch: batch_id, size, padding, and an array of each feature."""
        return self._batches(epoch, False)

    def bad_rows(self, epoch: int = 0) -> DataFrame:
        """(__store_idx, __row_idx, __pos, reason) of the rows that do not decode, among those the parameters leave."""
        return self.rows(epoch).where("__bad is not null").select("__store_idx", "__row_idx", rows.POS, F.col("__bad").alias("reason"))

    @property
    def num_bytes_read(self) -> int:
        """Bytes of the payloads of the batches that were read since the beginning or the last reset."""
        return self._bytes

    def _next(self, take: bool) -> Example | None:
        """The next batch that is not dropped; what befell it and those dropped before it is logged once."""
        if self._fault is not None:
            raise self._fault
        try:
            self._examples = self._examples or Ordered(self._batches(self.epoch, True), "batch_id")
            while (row := self._examples.peek()) is not None:
                if self._told != row["batch_id"]:
                    self._told = row["batch_id"]
                    for note in [*(row["__row_notes"] if self._notes else ()), *row["__notes"]]:
                        logger.warning(note)
                if row["__error"] is not None:
                    self._fault = InvalidInstanceError(row["__error"])
                    raise self._fault
                if row["__dropped"]:
                    self._examples.read()
                    continue
                if take:
                    self._bytes += self._examples.read()["__bytes"]
                return Example(row)
            return None
        except PySparkException as e:
            own = translated(e)
            if own is None:
                raise
            own.__cause__ = e
            self._fault = own
            raise own from e

    @property
    def _notes(self) -> bool:
        return self.params.warn_bad_instances

    def read_example(self) -> Example | None:
        return self._next(True)

    def peek_example(self) -> Example | None:
        return self._next(False)

    def __iter__(self) -> Iterator[Example]:
        while (example := self.read_example()) is not None:
            yield example

    def reset(self) -> None:
        """Begins the next epoch: from the first row, in another order where rows are reshuffled. An error that every
        read since has given again is forgotten."""
        if self._examples is not None or self._fault is not None:
            self.epoch += 1
        self._begin()

    def _begin(self) -> None:
        self._examples: Ordered | None = None
        self._fault: Exception | None = None
        self._told: int | None = None
        self._bytes = 0


class CsvReader(DataReader):
    def __init__(self, spark: SparkSession, paths: list, params: ReaderParams | None = None, csv_params: CsvParams | None = None):
        super().__init__(spark, paths, params)
        self.csv_params = csv_params or CsvParams()

    def source(self) -> DataFrame:
        return csv.read_csv(self.spark, self.stores(), self.csv_params)

    @property
    def _notes(self) -> bool:
        return super()._notes or self.csv_params.max_field_length_handling is MaxFieldLengthHandling.TRUNCATE_WARN


class TextLineReader(DataReader):
    """One feature, value. A line of max_line_length bytes or more is an error."""

    def __init__(self, spark: SparkSession, paths: list, params: ReaderParams | None = None, encoding: str | None = None, compression: str | None = None, max_line_length: int | None = None):
        super().__init__(spark, paths, params)
        self.encoding, self.compression, self.max_line_length = encoding, compression, max_line_length

    def source(self) -> DataFrame:
        own = lines.read_lines(self.spark, self.stores(), encoding=self.encoding, compression=self.compression)
        if self.max_line_length:
            over = F.raise_error(F.lit("RecordTooLargeError: a line exceeds max_line_length"))
            own = own.withColumn("value", F.when(F.octet_length("value") >= self.max_line_length, over).otherwise(F.col("value")))
        return own.withColumns({"__bytes": F.octet_length("value"), "__bad": F.lit(None).cast("string")})


class PipeReader(DataReader):
    """Lines of a named pipe, one pass an epoch: pass n reads PATH_n, beginning with fifo_id."""

    _once = True

    def __init__(self, spark: SparkSession, path: str, params: ReaderParams | None = None, timeout: float = 60.0, fifo_id: int = 0, compression: str = "none"):
        super().__init__(spark, [path], params)
        check_compression(compression)
        if compression == "infer":
            raise NotSupportedError("the compression of a pipe cannot be inferred")
        if self.params.sample_ratio is not None or self.params.shuffle_instances and self.params.shuffle_window == 0:
            raise NotSupportedError("a pipe is read once: samples and full shuffles need the number of rows before")
        self.timeout, self.fifo_id, self.compression = timeout, fifo_id, compression

    @property
    def _source(self) -> DataFrame:
        return self.source()

    def source(self) -> DataFrame:
        own = pipes.read_pipe(self.spark, self.paths[0], self.fifo_id + self.epoch, self.timeout, self.compression)
        extra = {"__store_idx": F.lit(0), "__row_idx": F.col(rows.POS), "__bytes": F.octet_length("value"), "__bad": F.lit(None).cast("string")}
        return own.withColumns(extra)


class TensorRecordReader(DataReader):
    """Framed records of named tensors; without a schema the first message gives it."""

    def __init__(self, spark: SparkSession, paths: list, params: ReaderParams | None = None, schema: Schema | None = None):
        super().__init__(spark, paths, params)
        self.schema = schema

    def source(self) -> DataFrame:
        return protobuf.read_protobuf(self.spark, self.stores(), self.schema)


class ImageReader(DataReader):
    """One feature, value: height, width, channels and the bytes of an image."""

    def __init__(self, spark: SparkSession, paths: list, params: ReaderParams | None = None, image_params: images.ImageParams | None = None):
        super().__init__(spark, paths, params)
        if image_params is None:
            raise ValueError("image_dimensions are needed")
        self.image_params = image_params

    def source(self) -> DataFrame:
        return images.read_images(self.spark, self.stores(), self.image_params)

    def padding(self) -> dict[str, Column]:
        n, h, w = self.image_params.image_dimensions
        sizes = (F.lit(v).alias(k) for k, v in (("height", h), ("width", w), ("channels", n)))
        return {"value": F.struct(*sizes, F.unhex(F.repeat(F.lit("00"), F.lit(n * h * w))).alias("data"))}
