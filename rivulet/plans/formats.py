"""Registered queries that go through files: tables are written in a format, read by the readers, and held against SQL.

Small stores are built from the small tables on the driver; larger ones are written by Spark.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.parsing import parse
from rivulet.operators import insights, rows, sketch, sparse
from rivulet.operators.position import POS, with_position
from rivulet.params import BadExampleHandling, CsvParams, LastExampleHandling, MaxFieldLengthHandling, ReaderParams
from rivulet.readers import CsvReader, ImageReader, TensorRecordReader, TextLineReader
from rivulet.sources import csv, lines, parquet_stream, recordio, stores
from rivulet.sources.images import ImageParams
from rivulet.sources.staging import new_path
from rivulet.streaming.adapters import as_arrow_file

from . import ranges
from .ranges import in_order, small_splits

RAW = CsvParams(header_row_index=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> list:
    """25 rows."""
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def put(spark: SparkSession, **files: bytes) -> list[str]:
    """Files of these contents in a folder of their own, in the order given."""
    folder = new_path(spark, "files")
    return [stores.put(spark, f"{folder}/{name}", data) for name, data in files.items()]


def in_files(df: DataFrame, name: str, **options) -> list[str]:
    """Ordered rows of one text column in files whose order is theirs, a file a task of the sort."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).text(path)
    return stores.list_objects(df.sparkSession, path, "*.txt*")


# --- delimited text -----------------------------------------------------------------------------------------------


def csv_with_empty_store(spark, sf_dir):
    """Customers in three files by key modulo 3, an empty file first, one that holds its header only, one file twice."""
    parts = []
    for k in range(3):
        own = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == k).orderBy("c_custkey").select(F.concat_ws(",", "c_custkey", "c_name").alias("value"))
        path = new_path(spark, "part")
        header = spark.createDataFrame([("key,name",)], "value string")
        header.coalesce(1).unionByName(own.coalesce(1)).coalesce(1).write.text(path)
        parts += stores.list_objects(spark, path, "*.txt")
    empty, bare = put(spark, empty=b"", bare=b"key,name\n")
    own = csv.read_csv(spark, [empty, parts[0], bare, parts[1], empty, parts[2], parts[0]])
    return own.select(F.col(POS).alias("pos"), F.col("__store_idx").alias("store"), F.col("__row_idx").alias("row"), F.col("key"))


def csv_single_header(spark, sf_dir):
    """The header stands in the first file that has lines; numbers go on in the next file."""
    own = [f"{r['n_nationkey']},{r['n_name']}" for r in nations(spark, sf_dir)]
    files = put(spark, a="\n".join(["key,name", *own[:10]]).encode(), b="\n".join(own[10:]).encode())
    return csv.read_csv(spark, files, CsvParams(has_single_header=True)).select(F.col(POS).alias("pos"), "key", "name")


def csv_quoted_fields(spark, sf_dir):
    """Properties with quotes in them, quoted, quotes doubled; the other fields plain."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    path = new_path(spark, "events")
    table(spark, sf_dir, "events").select(F.concat_ws(";", "event_id", quoted, "event_type").alias("value")).write.text(path)
    params = CsvParams(delimiter=";", header_row_index=None, column_names=("event_id", "props", "kind"))
    own = csv.read_csv(spark, stores.list_objects(spark, path, "*.txt"), params)
    return own.where("__bad is null").select("event_id", "props", "kind")


def csv_quoted_lines(spark, sf_dir):
    """Quoted fields that hold line ends."""
    quoted = F.concat(F.lit('"a\n'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('\r\nz"'))
    path = new_path(spark, "events")
    table(spark, sf_dir, "events").select(F.concat_ws(",", "event_id", quoted).alias("value")).write.text(path)
    params = CsvParams(header_row_index=None, column_names=("event_id", "props"), allow_quoted_new_lines=True)
    return csv.read_csv(spark, stores.list_objects(spark, path, "*.txt"), params).where("__bad is null").select("event_id", F.md5("props").alias("props_md5"))


def csv_comments_and_blanks(spark, sf_dir):
    """Each order's line after a comment and a blank line; neither takes a position."""
    line = F.concat_ws("|", "o_orderkey", "o_orderpriority")
    own = table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.explode(F.array(F.lit("# a|b"), F.lit(""), line)).alias("value"))
    params = CsvParams(delimiter="|", comment_char="#", header_row_index=None, column_names=("key", "priority"))
    return csv.read_csv(spark, in_files(own, "orders"), params).select("key", F.col(POS).alias("pos"))


def _field_limit(how):
    def query(spark, sf_dir):
        path = new_path(spark, "customers")
        table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value")).write.text(path)
        params = CsvParams(header_row_index=None, column_names=("key", "segment"), max_field_length=8, max_field_length_handling=how)
        own = csv.read_csv(spark, stores.list_objects(spark, path, "*.txt"), params)
        return own.select(F.coalesce("key", F.lit(-1)).alias("key"), "segment", F.coalesce("__bad", "__note").alias("said"))

    return query


def csv_bad_rows(spark, sf_dir):
    """Rows with a field too few and numbers that do not parse, as the reader reports them, with their reasons."""
    k = F.col("o_orderkey") % 50
    line = F.when(k == 3, F.col("o_orderkey").cast("string")).when(k == 7, F.concat(F.col("o_orderkey").cast("string"), F.lit(",x1f"))).otherwise(F.concat_ws(",", "o_orderkey", F.lit("5")))
    own = table(spark, sf_dir, "orders").orderBy("o_orderkey").select(line.alias("value"))
    reader = CsvReader(spark, in_files(own, "orders"), ReaderParams(batch_size=10), CsvParams(header_row_index=None, column_names=("key", "n"), column_types={"key": "int64", "n": "int32"}))
    return reader.bad_rows().select(F.col(POS).alias("pos"), "reason")


def _orders_text(spark, sf_dir):
    """Orders as files of four tasks, each with a header of a repeated and an empty name."""
    cells = (F.col("o_orderkey") % 100, F.col("o_orderstatus"), F.col("o_custkey") + F.lit(0.5), F.expr("cast(18446744073709551615BD - o_orderkey as decimal(20, 0))"))
    line = F.concat_ws(",", *(c.cast("string") for c in cells)).alias("a,b,a,")
    path = new_path(spark, "orders")
    in_order(table(spark, sf_dir, "orders"), "o_orderkey").select(line).write.options(header=True, quote="", escape="", sep="\1").csv(path)
    return stores.list_objects(spark, path, "*.csv")


def _by_column(spark, paths, ways):
    """What each way of reading makes of the columns, counted over all rows."""
    parts = []
    for way, p in ways.items():
        df = csv.read_csv(spark, paths, p)
        own = [(i, f) for i, f in enumerate(df.schema) if not f.name.startswith("__")]
        cells = (F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{i}").cast("string").alias("cell")) for i, f in own)
        flat = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(F.lit(way).alias("way"), F.explode(F.array(*cells)).alias("c"))
        parts.append(flat.groupBy("way", "c.place", "c.name", "c.type").agg(F.count("c.cell").alias("cells"), F.max("c.cell").alias("greatest")))
    return reduce(DataFrame.unionByName, parts)


def csv_names(spark, sf_dir):
    """Column names: from the header, with a prefix, given, and by number, where the headers are rows like others."""
    return _by_column(spark, _orders_text(spark, sf_dir), {
        "header": CsvParams(), "prefixed": CsvParams(name_prefix="p_"), "given": CsvParams(column_names=("w", "x", "y", "z"), name_prefix="p_"),
        "numbered": CsvParams(header_row_index=None), "numbered_prefixed": CsvParams(header_row_index=None, name_prefix="c"), "some": CsvParams(use_columns_by_index=frozenset({1, 2})),
    })


def csv_types(spark, sf_dir):
    """Column types: inferred, one for all, by name and by place."""
    return _by_column(spark, _orders_text(spark, sf_dir), {
        "inferred": CsvParams(), "all_text": CsvParams(default_data_type="string"), "by_name": CsvParams(column_types={"a": "float32", "b": "string"}),
        "by_place": CsvParams(column_types_by_index={0: "int8", 3: "string"}),
    })


def dedupe_names(spark, sf_dir):
    """Regions of the nations as a header of repeated names, read with names made unique."""
    own = nations(spark, sf_dir)
    (path,) = put(spark, names=(",".join(f"r{r['n_regionkey']}" for r in own) + "\n" + ",".join(str(r["n_nationkey"]) for r in own)).encode())
    df = csv.read_csv(spark, [path])
    names = [c for c in df.columns if not c.startswith("__")]
    return df.unpivot([POS], names, "name", "place").select("place", "name")


def csv_encodings(spark, sf_dir):
    """The same rows in Cyrillic, Latin-1 and, by their byte order marks, UTF-16 and UTF-8."""
    text = lambda word: "k,w\n" + "".join(f"{r['n_nationkey']},{word}{r['n_regionkey']}\n" for r in nations(spark, sf_dir))
    files = put(spark, a=text("привет").encode("iso8859_5"), b=text("été").encode("latin-1"), c=text("中文").encode("utf-16"), d=b"\xef\xbb\xbf" + text("中文").encode())
    own = [csv.read_csv(spark, [f], CsvParams(encoding=e)).select("k", "w") for f, e in zip(files, ("ISO-8859-5", "8859_1", None, None), strict=True)]
    return insights.concatenate(own).withColumnRenamed("__store_idx", "file")


# --- text, compression, stores ------------------------------------------------------------------------------------


def lines_of_all_ends(spark, sf_dir):
    """Lines that end in a line feed, a carriage return, or both, and a last one without an end."""
    ends = ["\n", "\r", "\r\n"]
    names = [r["n_name"] for r in nations(spark, sf_dir)]
    files = put(spark, a="".join(n + ends[i % 3] for i, n in enumerate(names)).encode() + b"last", b=b"")
    return lines.read_lines(spark, files).select(F.col(POS).alias("pos"), "value")


def lines_compressed(spark, sf_dir):
    """A gzip file by suffix and by parameter, in two members, and a zlib stream: one dataset of four files."""
    data = "".join(f"{r['n_name']}\n" for r in nations(spark, sf_dir)).encode()
    a, b, c, d = put(spark, **{"a.gz": gzip.compress(data), "b": gzip.compress(data[:30]) + gzip.compress(data[30:]), "c": zlib.compress(data), "d": data})
    own = lines.read_lines(spark, [stores.File(a), stores.File(b, "gzip"), stores.File(c, "gzip"), d])
    return own.select(F.col(POS).alias("pos"), F.col("__store_idx").alias("store"), "value")


class SquareStore(stores.DataStore):
    """A source of one's own: makes its lines where it is read."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last

    @property
    def id(self) -> str:
        return f"squares-{self.first}-{self.last}"

    @staticmethod
    def lines(first: int, last: int) -> bytes:
        return "".join(f"{i},{i * i}\n" for i in range(first, last)).encode()

    def open_read(self):
        return stores.InputStream(io.BytesIO(self.lines(self.first, self.last)))


def csv_own_stores(spark, sf_dir):
    """The keys of the customers with their squares, from sources of one's own and bytes in memory, plain and compressed,
    joined to the customers."""
    customer = table(spark, sf_dir, "customer")
    end = customer.agg(F.max("c_custkey")).first()[0] + 1
    size = min(max(25, end // 16), 100_000)
    own = [SquareStore(k, min(k + size, end - 5)) for k in range(0, end - 5, size)]
    packed = stores.InMemoryStore(gzip.compress(SquareStore.lines(end - 5, end - 3)), "gzip")
    reader = CsvReader(spark, [*own, packed, stores.InMemoryStore(SquareStore.lines(end - 3, end))], None, CsvParams(header_row_index=None, column_names=("n", "square")))
    return reader.rows().join(customer, F.col("n") == F.col("c_custkey"), "left").select(F.col(POS).alias("pos"), "n", "square", "c_name")


def natural_order(spark, sf_dir):
    """Customers in a folder a nation, read in the natural order of the folders (digits as numbers), one left out."""
    path = new_path(spark, "nations")
    table(spark, sf_dir, "customer").repartition("c_nationkey").select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    found = stores.list_objects(spark, path, "*.txt", lambda p: "=9/" not in p)
    return lines.read_lines(spark, found).select(F.col("__store_idx").cast("long").alias("place"), "value")


def text_reader_batches(spark, sf_dir):
    """Lines of the events through a reader: a shard in batches, the last one dropped."""
    own = table(spark, sf_dir, "events").orderBy("event_id").select(F.concat_ws(" ", "event_id", "event_type").alias("value"))
    params = ReaderParams(batch_size=32, num_shards=3, shard_index=2, last_example_handling=LastExampleHandling.DROP_WARN)
    batch = TextLineReader(spark, in_files(own, "events"), params).batches()
    return batch.select("batch_id", "size", F.aggregate("value", F.lit(0).cast("long"), lambda a, x: a + F.split(x, " ")[0].cast("long")).alias("ids"))


def reader_bytes(spark, sf_dir):
    """Bytes of the batches that a reader gave before and after it began again."""
    (path,) = put(spark, a="".join(f"{r['n_name']}\n" for r in nations(spark, sf_dir)).encode())
    reader = TextLineReader(spark, [path], ReaderParams(batch_size=10))
    one = reader.read_example() and reader.num_bytes_read
    n = len(list(reader))
    every = reader.num_bytes_read
    reader.reset()
    return spark.createDataFrame([(one, n, every, reader.num_bytes_read)], "first_batch long, batches_left long, all_batches long, after_reset long")


# --- records ------------------------------------------------------------------------------------------------------


def frame(kind: int, payload: bytes) -> bytes:
    return struct.pack("<II", recordio.MAGIC, kind << 29 | len(payload)) + payload + bytes(-len(payload) % 4)


def records_framed(spark, sf_dir):
    """Nation names as whole records in one file, and each as a split record in another."""
    names = [r["n_name"].encode() for r in nations(spark, sf_dir)]
    split = lambda p: frame(recordio.BEGIN, p[:1]) + frame(recordio.MIDDLE, p[1:3]) + frame(recordio.MIDDLE, b"") + frame(recordio.END, p[3:])
    files = put(spark, whole=b"".join(frame(recordio.COMPLETE, p) for p in names), split=b"".join(map(split, names)))
    own = recordio.read_records(spark, files)
    return own.select(F.col(POS).alias("pos"), F.col("__store_idx").alias("store"), F.col("payload").cast("string").alias("name"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor(values: list[int], keys: list[int] = (), shape: tuple[int, ...] = ()) -> bytes:
    """A value that is a tensor of 32-bit integers."""
    parts = [_field(n, b"".join(map(_varint, x))) for n, x in ((1, values), (2, keys), (3, shape)) if x]
    return _field(7, b"".join(parts))


def _message(features: dict[str, bytes], labels: dict[str, bytes]) -> bytes:
    entry = lambda number, name, value: _field(number, _field(1, name.encode()) + _field(2, value))
    return b"".join([*(entry(1, k, v) for k, v in features.items()), *(entry(2, k, v) for k, v in labels.items())])


def tensor_records(spark, sf_dir):
    """Nations as messages: a dense pair, a sparse row of 5 cells by region, and a label; batches of 4, the last padded."""
    told = [
        _message({"pair": _tensor([r["n_nationkey"], r["n_regionkey"]]), "row": _tensor([r["n_nationkey"] + 1], [r["n_regionkey"]], (5,))}, {"y": _tensor([r["n_regionkey"]])})
        for r in nations(spark, sf_dir)
    ]
    (path,) = put(spark, records=b"".join(frame(recordio.COMPLETE, m) for m in told))
    batch = TensorRecordReader(spark, [path], ReaderParams(batch_size=4, last_example_handling=LastExampleHandling.PAD_WARN)).batches()
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return batch.select(
        "batch_id", "padding", total(F.flatten("pair")).alias("pairs"), total(F.flatten("label_y")).alias("labels"),
        total(F.flatten(F.transform("row", lambda r: r["keys"]))).alias("keys"), total(F.flatten(F.transform("row", lambda r: r["values"]))).alias("values"),
    )


def parquet_streams(spark, sf_dir):
    """Orders as twelve Parquet files in three streams, read in many splits and opened by Arrow where they lie."""

    def opened(payload: pd.Series) -> pd.Series:
        import pyarrow.parquet as pq

        return pd.Series([pq.read_table(as_arrow_file(bytes(p)), columns=["o_orderkey"], partitioning=None).column(0).to_numpy() for p in payload])

    opened.__annotations__ = {"payload": pd.Series, "return": pd.Series}
    files, path = new_path(spark, "parquet"), new_path(spark, "streams")
    dealt = table(spark, sf_dir, "orders").withColumn("part", F.col("o_orderkey") % 12)
    dealt.repartition("part").write.partitionBy("part").parquet(files)
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(files)
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int")
    # a file's last byte is a 1, which the text writer sets as its line end
    body = F.expr("substring(content, 1, octet_length(content) - 1)").cast("string").alias("value")
    streams = held.select(part.alias("part"), F.floor(part / 4).alias("stream"), body).repartition("stream").sortWithinPartitions("stream", "part")
    streams.select("stream", "value").write.partitionBy("stream").option("lineSep", "1").text(path)
    own = parquet_stream.read_parquet_stream(small_splits(spark, path), stores.list_objects(spark, path, "*.txt"))
    return own.select(F.col(POS).alias("pos"), F.explode(F.pandas_udf(opened, "array<bigint>")("payload")).alias("key"))


def png(height: int, width: int, pixel: bytes) -> bytes:
    """An image of one colour: a byte of grey, three of red, green and blue, or four with the opacity."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = {1: 0, 3: 2, 4: 6}[len(pixel)]
    body = (b"\0" + pixel * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _pictures(keys: pd.Series) -> pd.Series:
    """An image for each key, of 1, 3 and 4 channels in turn; each tenth is junk."""

    def one(k: int) -> bytes:
        colour = bytes((k % 256, k * 7 % 256, k * 13 % 256, 255))
        return b"junk" if k % 10 == 7 else png(10 + k % 5, 30 - k % 5, (colour[:1], colour[:3], colour)[k % 3])

    return pd.Series([one(int(k)) for k in keys])


_pictures.__annotations__ = {"keys": pd.Series, "return": pd.Series}


def _pixels(reader: ImageReader) -> DataFrame:
    """Sizes and the first pixel of each image, its bytes in hexadecimal."""
    n = reader.image_params.image_dimensions[0]
    return reader.rows().select(
        F.col(POS).alias("pos"), "value.height", "value.width", "value.channels", F.octet_length("value.data").alias("bytes"),
        F.hex(F.substring("value.data", 1, n)).alias("first"), F.hex(F.substring("value.data", -n, n)).alias("last"), F.col("__bad").isNotNull().alias("bad"),
    )


def images_of_files(spark, sf_dir):
    """An image a supplier in a file of its own, resized to 8 and cut to 6 by 7, in red, green and blue."""
    path = new_path(spark, "pictures")
    rows_ = in_order(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.pandas_udf(_pictures, "binary")("s_suppkey").cast("string").alias("value"))
    rows_.write.option("maxRecordsPerFile", 1).text(path)
    return _pixels(ImageReader(spark, stores.list_objects(spark, path, "*.txt"), None, ImageParams((3, 6, 7), resize=8, to_rgb=True)))


def _framed_pictures(spark, sf_dir):
    """An image a part, framed, in files of four tasks. A zero byte ends each, which the text writer sets as its line end."""
    path = new_path(spark, "pictures")
    payload = F.concat(F.lit(bytes(24)), F.pandas_udf(_pictures, "binary")("p_partkey"), F.lit(b"\0"))
    framed = in_order(table(spark, sf_dir, "part"), "p_partkey").select(payload.alias("payload")).select(ranges.frame(recordio.COMPLETE, F.col("payload")).alias("data"))
    framed.select(F.expr("substring(data, 1, octet_length(data) - 1)").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return stores.list_objects(spark, path, "*.txt")


def images_of_records(spark, sf_dir):
    """An image a part in framed records, resized to 8 and cut to 6 by 7, in red, green and blue."""
    return _pixels(ImageReader(spark, _framed_pictures(spark, sf_dir), None, ImageParams((3, 6, 7), image_frame="recordio", resize=8, to_rgb=True)))


def images_of_channels(spark, sf_dir):
    """The same images to one channel and to four, which two thirds of them have not."""
    files = _framed_pictures(spark, sf_dir)
    own = [_pixels(ImageReader(spark, files, None, ImageParams((n, 6, 7), image_frame="recordio", to_rgb=True))).withColumn("wanted", F.lit(n)) for n in (1, 4)]
    return own[0].unionByName(own[1])


# --- shuffles, numbers, sketches ----------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return with_position(table(spark, sf_dir, "events").select("event_id"), "event_id")


def shuffle_full(spark, sf_dir):
    """A full shuffle moves rows, and its positions are those of all rows, each once."""
    df = _events(spark, sf_dir).withColumn("before", F.col(POS))
    own = rows.shuffled(df, seed=5)
    return own.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(POS).alias("places"), F.min(POS).alias("least"), F.max(POS).alias("most"),
        F.sum("event_id").alias("ids"), (F.count_if(F.col(POS) != F.col("before")) > 0.9 * F.count(F.lit(1))).alias("moved"),
    )


def epoch_shuffle_window(spark, sf_dir):
    """A shuffle through a buffer of 64 rows in the second epoch: where each row leaves it."""
    own = rows.shuffled(_events(spark, sf_dir), seed=5, window=64, epoch=1)
    return own.select("event_id", F.col(POS).alias("place"))


def shuffle_epochs(spark, sf_dir):
    """Epochs differ with reshuffling and agree without, seeds differ, and a window of one moves nothing."""
    df = _events(spark, sf_dir).withColumn("before", F.col(POS))
    at = lambda name, **how: rows.shuffled(df, **how).select("event_id", F.col(POS).alias(name))
    own = at("a", seed=1)
    for other in (at("b", seed=1, epoch=1), at("c", seed=1, epoch=1, reshuffle=False), at("d", seed=2), at("e", seed=1, window=1)):
        own = own.join(other, "event_id")
    own = own.join(df.select("event_id", "before"), "event_id")
    return own.agg(*((F.count_if(F.col(x) == F.col(y)) == F.count(F.lit(1))).alias(n) for n, x, y in (("epochs_agree", "a", "b"), ("kept_agree", "a", "c"), ("seeds_agree", "a", "d"), ("one_moves_nothing", "e", "before"))))


def parse_wide_numbers(spark, sf_dir):
    """Bounds of the unsigned 64-bit and the single-precision types, and numbers with exponents."""
    k = F.col("event_id") % 7
    c = (
        F.when(k == 0, "18446744073709551615").when(k == 1, "18446744073709551616").when(k == 2, "-1").when(k == 3, " +7 ")
        .when(k == 4, "1e400").when(k == 5, "2.5e3").otherwise(F.col("event_id").cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", parse(c, "uint64").cast("string").alias("u"), parse(c, "float32").cast("double").alias("f"), parse(c, "float16").isNull().alias("half"))


def _near(estimate, exact, share):
    return F.abs(estimate - exact) <= share * exact


def insights_cardinality(spark, sf_dir):
    """Estimated distinct cells against the true number."""
    names = ["c_name", "c_mktsegment"]
    df = table(spark, sf_dir, "customer")
    exact = df.agg(*(F.countDistinct(c).alias(c) for c in names)).unpivot([], names, "column", "distinct")
    told = insights.analyze(df, names).join(exact, "column")
    return told.select("column", "distinct", _near(F.col("string_cardinality"), F.col("distinct"), 0.02).alias("near"))


def insights_vocabulary(spark, sf_dir):
    """Estimated distinct words, split at single spaces, against the true number."""
    df = with_position(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"), "doc_id")
    trimmed = F.when(F.col("text").endswith(" "), F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    exact = df.where("text <> ''").select(F.explode(F.split(trimmed, " ")).alias("w")).agg(F.countDistinct("w")).first()[0]
    told = insights.analyze(df, ["text"], pos=POS)
    return told.select(F.lit(exact).cast("long").alias("words"), _near(F.col("string_vocab_cardinality"), F.lit(exact), 0.02).alias("near"))


def insights_full(spark, sf_dir):
    """Example, shortest text and median, with the other statistics, of two columns."""
    df = with_position(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("price")), "o_orderkey")
    told = insights.analyze(df, ["priority", "price"], pos=POS)
    return told.select("column", "rows_seen", "example_value", "string_min_length_not_empty", "numeric_count", F.round("numeric_finite_median_approx", 2).alias("median"))


def insights_to_dict(spark, sf_dir):
    """The analysis of a reader's rows as text: counts, numbers with six places, captured values."""
    (path,) = put(spark, a=("name,key\n" + "".join(f"{r['n_name']},{r['n_regionkey']}\n" for r in nations(spark, sf_dir))).encode())
    reader = CsvReader(spark, [path], None, CsvParams(default_data_type="string"))
    own = insights.analyze_dataset(reader, capture_columns=[1], max_capture_count=3)
    held = [(c.column_name, k, str(v)) for c in own.columns for k, v in c.to_dict().items() if k not in ("string_cardinality", "string_vocab_cardinality", "string_captured_unique_values")]
    held += [(c.column_name, f"captured {v}", str(n)) for c in own.columns for v, n in c.string_captured_unique_values.items()]
    return spark.createDataFrame(held, "column string, statistic string, value string")


def hll_cardinality(spark, sf_dir):
    """The register sketch, made in two halves and merged, against the true number and the sketch of the whole."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    half = df.select("k", (F.crc32(F.col("k").cast("binary")) % 2 == 0).alias("h"))
    merged = sketch.merge(sketch.registers(half.where("h"), "k"), sketch.registers(half.where("not h"), "k"))
    keys, whole = df.agg(F.countDistinct("k")).first()[0], sketch.estimate(sketch.registers(df, "k")).first()[0]
    own = sketch.estimate(merged, "merged")
    return own.select(F.lit(keys).cast("long").alias("keys"), _near(F.lit(whole), F.lit(keys), 0.02).alias("near"), (F.col("merged") == whole).alias("merges"))


def sketches_by_key(spark, sf_dir):
    """Customers of each order priority and of all, estimated from two halves that were written, read and merged."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_custkey")
    half = sketch.sketches(df.withColumn("half", F.col("o_orderkey") % 2), "o_custkey", ["half", "priority"])
    path = new_path(spark, "sketches")
    half.write.partitionBy("half").parquet(path)
    held = spark.read.parquet(path)
    merged = sketch.merge_sketches(held, ["priority"]).unionByName(sketch.merge_sketches(held).withColumn("priority", F.lit("all")))
    whole = sketch.sketches(df, "o_custkey", ["priority"]).unionByName(sketch.sketches(df, "o_custkey").withColumn("priority", F.lit("all")))
    exact = df.groupBy("priority").agg(F.countDistinct("o_custkey").alias("customers")).unionByName(df.agg(F.countDistinct("o_custkey").alias("customers")).withColumn("priority", F.lit("all")))
    told = merged.join(whole.withColumnRenamed("sketch", "whole"), "priority").join(exact, "priority")
    return told.select("priority", "customers", _near(sketch.cardinality(), F.col("customers"), 0.02).alias("near"), (F.col("sketch") == F.col("whole")).alias("merges"))


def sparse_coo_coordinates(spark, sf_dir):
    """Linear keys of large embedding entries to the coordinates of a matrix of 8 columns."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("key", "value")).where(F.col("value") > F.lit(0.15).cast("float"))
    at = cells.withColumn("at", sparse.coordinates(F.col("key").cast("long"), (8, 8)))
    return at.select("vec_id", F.col("at")[0].alias("i"), F.col("at")[1].alias("j"), F.round(F.col("value").cast("double"), 5).alias("value"))


QUERIES = {
    "csv_with_empty_store": csv_with_empty_store, "csv_single_header": csv_single_header, "csv_quoted_fields": csv_quoted_fields, "csv_quoted_lines": csv_quoted_lines,
    "csv_comments_and_blanks": csv_comments_and_blanks, "csv_field_limit_bad": _field_limit(MaxFieldLengthHandling.TREAT_AS_BAD),
    "csv_field_limit_cut": _field_limit(MaxFieldLengthHandling.TRUNCATE_WARN), "csv_bad_rows": csv_bad_rows, "csv_names": csv_names, "csv_types": csv_types,
    "dedupe_names": dedupe_names, "csv_encodings": csv_encodings, "lines_of_all_ends": lines_of_all_ends, "lines_compressed": lines_compressed,
    "csv_own_stores": csv_own_stores, "natural_order": natural_order, "text_reader_batches": text_reader_batches, "reader_bytes": reader_bytes,
    "records_framed": records_framed, "tensor_records": tensor_records, "parquet_streams": parquet_streams,
    "images_of_files": images_of_files, "images_of_records": images_of_records, "images_of_channels": images_of_channels,
    "shuffle_full": shuffle_full, "epoch_shuffle_window": epoch_shuffle_window, "shuffle_epochs": shuffle_epochs, "parse_wide_numbers": parse_wide_numbers,
    "insights_cardinality": insights_cardinality, "insights_vocabulary": insights_vocabulary, "insights_full": insights_full, "insights_to_dict": insights_to_dict,
    "hll_cardinality": hll_cardinality, "sketches_by_key": sketches_by_key, "sparse_coo_coordinates": sparse_coo_coordinates,
}

_N = "(SELECT *, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS p FROM nation)"
_E = "(SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS p FROM events)"
_O = "(SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS p FROM orders)"


def _image_sql(key: str, name: str, wanted: int) -> str:
    """Pixels of the images of a table's keys, to `wanted` channels."""
    grey = "printf('%02X', CAST(round_even(0.114 * blue + 0.587 * green + 0.299 * red, 0) AS INTEGER))"
    first = {1: f"CASE have WHEN 1 THEN printf('%02X', red) ELSE {grey} END", 3: "printf('%02X%02X%02X', red, green, blue)", 4: "printf('%02X%02X%02XFF', red, green, blue)"}[wanted]
    bad = "k % 10 = 7" + (" OR have <> 4" if wanted == 4 else "")
    return f"""
        SELECT pos, CASE WHEN NOT bad THEN 6 END AS height, CASE WHEN NOT bad THEN 7 END AS width, CASE WHEN NOT bad THEN {wanted} END AS channels,
               CASE WHEN NOT bad THEN {42 * wanted} END AS bytes, CASE WHEN NOT bad THEN pixel END AS "first", CASE WHEN NOT bad THEN pixel END AS "last", bad
        FROM (SELECT *, {first} AS pixel, {bad} AS bad FROM (
          SELECT {key} AS k, CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS pos, [1, 3, 4][CAST({key} % 3 + 1 AS INTEGER)] AS have, CAST({key} % 256 AS INTEGER) AS red,
                 CAST((CASE {key} % 3 WHEN 0 THEN {key} ELSE {key} * 7 END) % 256 AS INTEGER) AS green, CAST((CASE {key} % 3 WHEN 0 THEN {key} ELSE {key} * 13 END) % 256 AS INTEGER) AS blue FROM {name}))"""


#: Of each column that _orders_text writes: its number, name in the header, rows and greatest cell as text.
_CELLS = """WITH cells(src, head, n, most) AS (
        SELECT 0, 'a', count(*), max(CAST(o_orderkey % 100 AS VARCHAR)) FROM orders UNION ALL SELECT 1, 'b', count(*), max(o_orderstatus) FROM orders
        UNION ALL SELECT 2, 'a', count(*), max(o_custkey || '.5') FROM orders UNION ALL SELECT 3, '', count(*), max(CAST(18446744073709551615::HUGEINT - o_orderkey AS VARCHAR)) FROM orders)"""


def _key(salt: int) -> int:
    """The key of draws below step 2^32, of seed 6 (seed 5, second epoch)."""

    def mix(x: int) -> int:
        x = (x ^ x >> 16) * 0x85EBCA6B % (1 << 32)
        x = (x ^ x >> 13) * 0xC2B2AE35 % (1 << 32)
        return x ^ x >> 16

    return mix(mix(6 ^ mix(0) ^ salt))


_BUFFER = f"""
    WITH a AS (SELECT t, xor(t::UBIGINT, {_key(0)}::UBIGINT) AS x, xor(t::UBIGINT, {_key(0x9E3779B9)}::UBIGINT) AS y FROM range((SELECT count(*) FROM events) + 8192) r(t)),
    b AS (SELECT t, xor(x, x >> 16) * 2246822507::UBIGINT & 4294967295::UBIGINT AS x, xor(y, y >> 16) * 2246822507::UBIGINT & 4294967295::UBIGINT AS y FROM a),
    c AS (SELECT t, xor(x, x >> 13) * 3266489909::UBIGINT & 4294967295::UBIGINT AS x, xor(y, y >> 13) * 3266489909::UBIGINT & 4294967295::UBIGINT AS y FROM b),
    d AS (SELECT t, xor(x, x >> 16) AS x, xor(y, y >> 16) AS y FROM c),
    put AS (SELECT t, CAST((x * 2147483648::UBIGINT + (y >> 1)) % 64 AS BIGINT) AS slot FROM d UNION ALL SELECT t - 64, t FROM range(64) r(t)),
    gone AS (SELECT t + 64 AS p, lead(t) OVER (PARTITION BY slot ORDER BY t) AS leaves FROM put)
    SELECT event_id, CAST(row_number() OVER (ORDER BY leaves) - 1 AS BIGINT) AS place FROM gone JOIN {_E} e USING (p)"""

ORACLE_SQL = {
    "csv_with_empty_store": """WITH c AS (SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS k, CAST(row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS BIGINT) AS r FROM customer),
        n AS (SELECT count(*) FILTER (k = 0) AS a, count(*) FILTER (k <= 1) AS b, count(*) AS c FROM c)
        SELECT r - 1 + CASE k WHEN 0 THEN 0 WHEN 1 THEN n.a ELSE n.b END AS pos, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS store, r AS row, c_custkey AS key FROM c, n
        UNION ALL SELECT r - 1 + n.c, 6, r, c_custkey FROM c, n WHERE k = 0""",
    "csv_single_header": f"SELECT p AS pos, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM {_N}",
    "csv_quoted_fields": "SELECT event_id, props, event_type AS kind FROM events",
    "csv_quoted_lines": "SELECT event_id, md5('a' || chr(10) || props || chr(13) || chr(10) || 'z') AS props_md5 FROM events",
    "csv_comments_and_blanks": f"SELECT o_orderkey AS key, p AS pos FROM {_O}",
    "csv_field_limit_bad": "SELECT CASE WHEN length(c_mktsegment) > 8 THEN -1 ELSE c_custkey END AS key, CASE WHEN length(c_mktsegment) <= 8 THEN c_mktsegment END AS segment, CASE WHEN length(c_mktsegment) > 8 THEN 'a field is too long' END AS said FROM customer",
    "csv_field_limit_cut": "SELECT c_custkey AS key, left(c_mktsegment, 8) AS segment, CASE WHEN length(c_mktsegment) > 8 THEN 'a field was cut' END AS said FROM customer",
    "csv_bad_rows": f"SELECT p AS pos, CASE o_orderkey % 50 WHEN 3 THEN '1 fields instead of 2' ELSE 'n is not int32: ''x1f''' END AS reason FROM {_O} WHERE o_orderkey % 50 IN (3, 7)",
    "csv_names": _CELLS + """, named(way, src, place, name) AS (VALUES
        ('header', 0, 0, 'a'), ('header', 1, 1, 'b'), ('header', 2, 2, 'a_1'), ('header', 3, 3, ''), ('prefixed', 0, 0, 'p_a'), ('prefixed', 1, 1, 'p_b'), ('prefixed', 2, 2, 'p_a_1'), ('prefixed', 3, 3, 'p_'),
        ('given', 0, 0, 'w'), ('given', 1, 1, 'x'), ('given', 2, 2, 'y'), ('given', 3, 3, 'z'), ('numbered', 0, 0, '1'), ('numbered', 1, 1, '2'), ('numbered', 2, 2, '3'), ('numbered', 3, 3, '4'),
        ('numbered_prefixed', 0, 0, 'c1'), ('numbered_prefixed', 1, 1, 'c2'), ('numbered_prefixed', 2, 2, 'c3'), ('numbered_prefixed', 3, 3, 'c4'), ('some', 1, 0, 'b'), ('some', 2, 1, 'a'))
        SELECT way, CAST(place AS INTEGER) AS place, name, CASE WHEN way LIKE 'numbered%' THEN 'string' ELSE ['bigint', 'string', 'double', 'decimal(20,0)'][src + 1] END AS type,
               n + CASE WHEN way LIKE 'numbered%' THEN 4 ELSE 0 END AS cells, CASE WHEN way LIKE 'numbered%' THEN greatest(most, head) ELSE most END AS greatest FROM named JOIN cells USING (src)""",
    "csv_types": _CELLS + """, typed(way, src, name, type) AS (VALUES
        ('inferred', 0, 'a', 'bigint'), ('inferred', 1, 'b', 'string'), ('inferred', 2, 'a_1', 'double'), ('inferred', 3, '', 'decimal(20,0)'),
        ('all_text', 0, 'a', 'string'), ('all_text', 1, 'b', 'string'), ('all_text', 2, 'a_1', 'string'), ('all_text', 3, '', 'string'),
        ('by_name', 0, 'a', 'float'), ('by_name', 1, 'b', 'string'), ('by_name', 2, 'a_1', 'double'), ('by_name', 3, '', 'decimal(20,0)'),
        ('by_place', 0, 'a', 'tinyint'), ('by_place', 1, 'b', 'string'), ('by_place', 2, 'a_1', 'double'), ('by_place', 3, '', 'string'))
        SELECT way, CAST(src AS INTEGER) AS place, name, type, n AS cells, most || CASE WHEN type = 'float' THEN '.0' ELSE '' END AS greatest FROM typed JOIN cells USING (src)""",
    "dedupe_names": "SELECT n_nationkey::BIGINT AS place, 'r' || n_regionkey || CASE WHEN r > 0 THEN '_' || r ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation)",
    "csv_encodings": "SELECT CAST(n_nationkey AS BIGINT) AS k, w || n_regionkey AS w, file FROM nation, (VALUES (0, 'привет'), (1, 'été'), (2, '中文'), (3, '中文')) t(file, w)",
    "lines_of_all_ends": f"SELECT p AS pos, n_name AS value FROM {_N} UNION ALL SELECT 25, 'last'",
    "lines_compressed": f"SELECT 25 * s + p AS pos, CAST(s AS INTEGER) AS store, n_name AS value FROM {_N}, range(4) t(s)",
    "csv_own_stores": "SELECT n AS pos, n, n * n AS square, c_name FROM range((SELECT max(c_custkey) + 1 FROM customer)) t(n) LEFT JOIN customer ON c_custkey = n",
    "natural_order": "SELECT dense_rank() OVER (ORDER BY c_nationkey) - 1 AS place, c_name AS value FROM customer WHERE c_nationkey <> 9",
    "text_reader_batches": f"SELECT p // 96 AS batch_id, 32 AS size, CAST(sum(event_id) AS BIGINT) AS ids FROM {_E} WHERE p % 3 = 2 GROUP BY 1 HAVING count(*) = 32",
    "reader_bytes": f"SELECT CAST(sum(strlen(n_name)) FILTER (p < 10) AS BIGINT) AS first_batch, CAST(2 AS BIGINT) AS batches_left, CAST(sum(strlen(n_name)) AS BIGINT) AS all_batches, CAST(0 AS BIGINT) AS after_reset FROM {_N}",
    "records_framed": f"SELECT p + 25 * s AS pos, CAST(s AS INTEGER) AS store, n_name AS name FROM {_N}, range(2) t(s)",
    "tensor_records": f"""SELECT p // 4 AS batch_id, CAST(4 - count(*) AS INTEGER) AS padding, CAST(sum(n_nationkey + n_regionkey) AS BIGINT) AS pairs, CAST(sum(n_regionkey) AS BIGINT) AS labels,
        CAST(sum(n_regionkey) AS BIGINT) AS keys, CAST(sum(n_nationkey + 1) AS BIGINT) AS values FROM {_N} GROUP BY 1""",
    "parquet_streams": "SELECT o_orderkey % 12 AS pos, o_orderkey AS key FROM orders",
    "images_of_files": _image_sql("s_suppkey", "supplier", 3),
    "images_of_records": _image_sql("p_partkey", "part", 3),
    "images_of_channels": f"SELECT *, 1 AS wanted FROM ({_image_sql('p_partkey', 'part', 1)}) UNION ALL SELECT *, 4 FROM ({_image_sql('p_partkey', 'part', 4)})",
    "shuffle_full": "SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, CAST(sum(event_id) AS BIGINT) AS ids, true AS moved FROM events",
    "epoch_shuffle_window": _BUFFER,
    "shuffle_epochs": "SELECT false AS epochs_agree, true AS kept_agree, false AS seeds_agree, true AS one_moves_nothing",
    "parse_wide_numbers": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '18446744073709551615' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '7' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE event_id::VARCHAR END AS u,
        CAST(CASE event_id % 7 WHEN 0 THEN 18446744073709551615::FLOAT WHEN 1 THEN 18446744073709551616::FLOAT WHEN 2 THEN -1::FLOAT WHEN 3 THEN 7::FLOAT WHEN 4 THEN NULL WHEN 5 THEN 2500::FLOAT ELSE event_id::FLOAT END AS DOUBLE) AS f, true AS half FROM events""",
    "insights_cardinality": "SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS \"distinct\", true AS near FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), true FROM customer",
    "insights_vocabulary": "SELECT count(DISTINCT w) AS words, true AS near FROM (SELECT unnest(string_split(CASE WHEN text LIKE '% ' THEN left(text, length(text) - 1) ELSE text END, ' ')) AS w FROM documents WHERE text <> '')",
    "insights_full": f"""SELECT 'priority' AS "column", count(*) AS rows_seen, (SELECT o_orderpriority FROM {_O} WHERE p = 0) AS example_value, min(length(o_orderpriority)) AS string_min_length_not_empty,
        CAST(0 AS BIGINT) AS numeric_count, 'nan'::DOUBLE AS median FROM orders
        UNION ALL SELECT 'price', count(*), (SELECT CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) FROM {_O} WHERE p = 0), min(length(CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR))), count(*),
        (SELECT list_sort(list(x))[len(list(x)) // 2 + 1] FROM (SELECT CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS DOUBLE) AS x FROM {_O} WHERE p < 10000)) FROM orders""",
    "insights_to_dict": """WITH t AS (SELECT n_name AS name, n_regionkey::VARCHAR AS key, n_nationkey AS p FROM nation),
        s AS (SELECT 'name' AS "column", MAP {'rows_seen': count(*)::VARCHAR, 'numeric_count': '0', 'numeric_finite_count': '0', 'numeric_nan_count': count(*)::VARCHAR, 'numeric_int_count': '0', 'string_empty_count': '0',
          'string_min_length': min(strlen(name))::VARCHAR, 'string_min_length_not_empty': min(strlen(name))::VARCHAR, 'string_max_length': max(strlen(name))::VARCHAR, 'string_only_whitespace_count': '0', 'string_null_like_count': '0',
          'string_num_words': sum(len(string_split(name, ' ')))::BIGINT::VARCHAR, 'numeric_finite_mean': 'nan', 'numeric_finite_min': 'nan', 'numeric_finite_max': 'nan', 'string_avg_length': printf('%.6f', sum(strlen(name))::DOUBLE / count(*)),
          'example_value': arg_min(name, p), 'numeric_finite_median_approx': 'nan', 'string_captured_unique_values_overflowed': 'False'} AS m FROM t
        UNION ALL SELECT 'key', MAP {'rows_seen': count(*)::VARCHAR, 'numeric_count': count(*)::VARCHAR, 'numeric_finite_count': count(*)::VARCHAR, 'numeric_nan_count': '0', 'numeric_int_count': count(*)::VARCHAR, 'string_empty_count': '0',
          'string_min_length': '1', 'string_min_length_not_empty': '1', 'string_max_length': '1', 'string_only_whitespace_count': '0', 'string_null_like_count': '0', 'string_num_words': count(*)::VARCHAR,
          'numeric_finite_mean': printf('%.6f', avg(key::DOUBLE)), 'numeric_finite_min': printf('%.6f', min(key::DOUBLE)), 'numeric_finite_max': printf('%.6f', max(key::DOUBLE)), 'string_avg_length': '1.000000',
          'example_value': arg_min(key, p), 'numeric_finite_median_approx': list_sort(list(key::DOUBLE))[13]::VARCHAR, 'string_captured_unique_values_overflowed': 'True'} FROM t)
        SELECT "column", e.key AS statistic, e.value AS value FROM (SELECT "column", unnest(map_entries(m)) AS e FROM s)
        UNION ALL SELECT 'key', 'captured ' || key, n::VARCHAR FROM (SELECT key, count(*) AS n, min(p) AS f FROM t GROUP BY key ORDER BY f LIMIT 3)""",
    "sketches_by_key": "SELECT coalesce(o_orderpriority, 'all') AS priority, count(DISTINCT o_custkey) AS customers, true AS near, true AS merges FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())",
    "hll_cardinality": "SELECT count(DISTINCT o_orderkey) AS keys, true AS near, true AS merges FROM orders",
    "sparse_coo_coordinates": "SELECT vec_id, CAST((k - 1) // 8 AS BIGINT) AS i, CAST((k - 1) % 8 AS BIGINT) AS j, round(CAST(embedding[k] AS DOUBLE), 5) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) WHERE embedding[k] > 0.15",
}
