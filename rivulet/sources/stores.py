"""Stores and ordered lists of them: files, bytes in memory, sources of one's own."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import os
import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import BinaryIO
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from rivulet.errors import InflateError, NotSupportedError, StreamError
from rivulet.operators.position import POS

#: Bytes up to which a table of files or splits is broadcast; above, Spark chooses the join.
BROADCAST_BYTES = 64 << 20


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows of the driver, as Arrow: no Python process of an executor has to unpickle them."""
    own = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(own)]
    return spark.createDataFrame(pa.table(columns, names=own.names), own)


def natural_key(name: str) -> list:
    """Digit runs compare as numbers."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name) if p]


def list_files(paths: str | Iterable[str], pattern: str = "", predicate: Callable[[str], bool] | None = None) -> list[str]:
    """Files under the paths, links followed, in natural order in each folder; pattern matches the whole path."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        if not path or path[-1] in "/\\" and not os.path.isdir(path):
            raise ValueError(f"no file or folder: {path!r}")
        if os.path.isdir(path):
            for name in sorted(os.listdir(path), key=natural_key):
                found += list_files(os.path.join(path, name))
        else:
            found.append(path)
    return [p for p in found if (not pattern or fnmatch.fnmatchcase(p, pattern)) and (predicate is None or predicate(p))]


def list_objects(spark: SparkSession, uris: str | Iterable[str], pattern: str = "", predicate: Callable[[str], bool] | None = None) -> list[str]:
    """Files under the URIs of any file system that Spark reads, in natural order over all of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([uris] if isinstance(uris, str) else list(uris))
    found = sorted(map(unquote, files.inputFiles()), key=natural_key)
    return [p for p in found if (not pattern or fnmatch.fnmatchcase(p, pattern)) and (predicate is None or predicate(p))]


@dataclass(frozen=True)
class File:
    """A file with its compression: "infer" by suffix, "none" or "gzip" (zlib too)."""

    path: str
    compression: str = "infer"

    def __post_init__(self):
        if not self.path or self.path[-1] in "/\\":
            raise ValueError(f"not the path of a file: {self.path!r}")
        check_compression(self.compression)


class DataStore:
    """A source of one's own: subclasses give an identifier and open_read(), a binary stream, which is called where
    the data is read; so instances are sent to tasks."""

    compression = "none"

    @property
    def id(self) -> str:
        raise NotImplementedError

    def open_read(self) -> BinaryIO:
        raise NotImplementedError


class InMemoryStore(DataStore):
    """Bytes of the driver."""

    def __init__(self, data: bytes, compression: str = "none"):
        if compression == "infer":
            raise NotSupportedError("the compression of a buffer cannot be inferred")
        check_compression(compression)
        self.data, self.compression = bytes(data), compression

    @property
    def id(self) -> str:
        return f"memory-{hashlib.sha256(self.data).hexdigest()[:16]}-{len(self.data)}"

    def open_read(self) -> BinaryIO:
        return InputStream(io.BytesIO(self.data))


class InputStream(io.RawIOBase):
    """A readable stream over another; whatever is asked of it after it was closed is a StreamError."""

    def __init__(self, raw: BinaryIO):
        self._raw = raw

    def _open(self) -> BinaryIO:
        if self.closed:
            raise StreamError("the stream is closed")
        return self._raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return self._open().seekable()

    def read(self, size: int = -1) -> bytes:
        return self._open().read(size)

    def readinto(self, buffer) -> int:
        data = self._open().read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self._open().seek(offset, whence)

    def tell(self) -> int:
        return self._open().tell()

    def close(self) -> None:
        if not self.closed:
            self._raw.close()
        super().close()


def check_compression(kind: str) -> None:
    if kind in ("bzip2", "zip"):
        raise NotSupportedError(f"{kind} is not read")
    if kind not in ("infer", "none", "gzip"):
        raise ValueError(f"unknown compression {kind!r}")


def name_of(store: str | File | DataStore) -> str:
    """What rows of a store carry as its path."""
    return store if isinstance(store, str) else store.path if isinstance(store, File) else f"store:{store.id}"


def special(stores: list, compression: str | None = None) -> bool:
    """Whether Spark's own readers would not take the stores as they are: of one's own, or packed otherwise than their
    names say."""
    kinds = [compression or (getattr(s, "compression", "infer")) for s in stores]
    return any(isinstance(s, DataStore) for s in stores) or any(k != "infer" and (compression_of(name_of(s)) or "none") != k for s, k in zip(stores, kinds, strict=True))


def contents(spark: SparkSession, stores: list, compression: str | None = None) -> DataFrame:
    """(path, content): the inflated bytes of each store, once if it stands in the list again. compression holds for
    all of them; None is each one's own."""
    files = sorted({name_of(s) for s in stores if not isinstance(s, DataStore)})
    own = {name_of(s): s for s in stores if isinstance(s, DataStore)}
    kinds = {plain(name_of(s)): k for s in stores if (k := compression or getattr(s, "compression", "infer")) != "infer"}
    parts = []
    if files:
        parts.append(spark.read.format("binaryFile").load(files).select("path", "content"))
    if own:
        rows = spark.createDataFrame([(name, cloudpickle.dumps(s)) for name, s in own.items()], "path string, store binary")

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, raw in zip(b["path"], b["store"], strict=True):
                    with pickle.loads(bytes(raw)).open_read() as stream:
                        yield pd.DataFrame({"path": [path], "content": [stream.read()]})

        parts.append(rows.repartition(len(own)).mapInPandas(opened, "path string, content binary"))

    def unpacked(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([inflate(c) if kinds.get(plain(p), compression_of(p) or "none") == "gzip" else c for p, c in zip(path, map(bytes, content), strict=True)])

    unpacked.__annotations__ = {"path": pd.Series, "content": pd.Series, "return": pd.Series}
    held = reduce(DataFrame.unionByName, parts)
    if any(kinds.get(plain(n), compression_of(n)) == "gzip" for n in [*files, *own]):
        held = held.select("path", F.pandas_udf(unpacked, "binary")("path", "content").alias("content"))
    return held


def inflate(data: bytes) -> bytes:
    """gzip or zlib, members one after the other."""
    out = []
    while data:
        stream = zlib.decompressobj(32 + zlib.MAX_WBITS)
        try:
            out.append(stream.decompress(data) + stream.flush())
        except zlib.error as e:
            raise InflateError("the stream does not inflate") from e
        if not stream.eof:
            raise InflateError("the stream is cut off")
        data = stream.unused_data
    return b"".join(out)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes bytes of the driver as a file of any file system that Spark writes."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(own)
    out.write(bytearray(data))
    out.close()
    return path


def in_memory(spark: SparkSession, buffers: Iterable[bytes]) -> DataFrame:
    """(__store_idx, content) of buffers of the driver, each a store."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(buffers)], "__store_idx int, content binary")


def plain(path: str) -> str:
    """A path without scheme and leading slashes, as the same file has different spellings."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:", "", path).lstrip("/")


def with_store(df: DataFrame, paths: list, origin: Column, rows: dict[str, int] | None = None) -> DataFrame:
    """Adds __store_idx, the place of the origin in paths; with rows of each file also __pos from __row_idx. Rows of a
    store that stands in paths again are there as often."""
    held, at = [], 0
    for i, p in enumerate(paths):
        own = plain(name_of(p))
        held.append((own, i, at))
        at += (rows or {}).get(own, 0)
    table = df.sparkSession.createDataFrame(held, "__file string, __store_idx int, __before long")
    table = F.broadcast(table) if sum(len(p) + 24 for p, _, _ in held) <= BROADCAST_BYTES else table
    name = F.regexp_replace(F.regexp_replace(origin, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^/+", "")
    joined = df.withColumn("__file", name).join(table, "__file")
    if rows is not None:
        joined = joined.withColumn(POS, F.col("__row_idx") + F.col("__before"))
    return joined.drop("__file", "__before")


def numbered(df: DataFrame, paths: list) -> DataFrame:
    """Rows (path, __row_idx, ...) with __store_idx and __pos: one count for each file goes through the driver."""
    counts = {plain(r["path"]): r["n"] for r in df.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    return with_store(df, paths, F.col("path"), counts)


def compression_of(path: str) -> str | None:
    """By suffix; gzip is read by Spark itself."""
    kind = {".gz": "gzip", ".bz2": "bzip2", ".zip": "zip"}.get(os.path.splitext(path)[1])
    if kind == "zip":
        raise NotSupportedError(f"zip archives are not read: {path}")
    return kind
