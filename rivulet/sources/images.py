"""Images as rows of height, width, channels and bytes.

Spark's image source decodes (JPEG, PNG, GIF, BMP). It reads files, so of images inside framed records or stores of one's
own those that are not plain PNGs are first written to the shared folder, a file an image in one folder, and joined back by
the files' names. Plain PNGs (8 bits of grey, colour or colour and opacity, rows unfiltered or filtered by the byte before
or above) are their pixels, packed; they, and bytes that begin like no format, need no file. Resize, crop and channels work
on Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rivulet.errors import CorruptRecordError, NotSupportedError

from .lines import frozen
from .recordio import read_records
from .staging import new_path
from .stores import contents, name_of, special, with_store

#: Fixed value: bytes before the image in a framed record.
RECORD_HEADER = 24
#: Bytes of written rows that a task takes.
PART_BYTES = 32 << 20
#: Bytes that a file counts for when files of images are dealt to tasks, some 2,000 small ones each.
FILE_BYTES = 64 << 10
#: What files of the formats that Spark's image source reads begin with (the last of them is WBMP).
PNG = b"\x89PNG\r\n\x1a\n"
SIGNATURES = (PNG, b"\xff\xd8", b"GIF8", b"BM", b"II", b"MM", b"\0")
#: Fixed values of PNG: channels by the kind of its colours, and chunks that leave pixels as they are.
PNG_CHANNELS = {0: 1, 2: 3, 6: 4}
PNG_CHUNKS = (b"IHDR", b"IDAT", b"IEND", b"tEXt", b"pHYs", b"tIME")
#: How the bytes of an image become pixels.
NONE, PLAIN, BY_FILE = range(3)
IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
OUT = "struct<height: int, width: int, channels: int, data: binary, why: string>"


@dataclass(frozen=True)
class ImageParams:
    """image_dimensions: channels, height, width. resize: length of the shorter edge before the crop."""

    image_dimensions: tuple[int, int, int]
    image_frame: str = "none"
    resize: int | None = None
    to_rgb: bool = False

    def __post_init__(self):
        if len(self.image_dimensions) != 3:
            raise ValueError("image_dimensions must be channels, height and width")
        if self.image_dimensions[0] not in (1, 3, 4):
            raise ValueError("images have 1, 3 or 4 channels")
        if self.image_frame not in ("none", "recordio"):
            raise ValueError(f"unknown image frame {self.image_frame!r}")


def channels(image: np.ndarray, n: int) -> np.ndarray:
    """To n channels; four must be there already."""
    have = image.shape[2]
    if n == have:
        return image
    if n == 4:
        raise CorruptRecordError("the image has no four channels")
    if n == 3:
        return np.repeat(image, 3, axis=2) if have == 1 else image[:, :, :3]
    weights = np.array([0.114, 0.587, 0.299])  # of blue, green and red
    return np.clip(np.rint(image[:, :, :3] @ weights), 0, 255).astype(np.uint8)[:, :, None]


def _axis(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, source - 1), at - low


def resize(image: np.ndarray, shorter: int) -> np.ndarray:
    """Bilinear; the shorter edge gets the length, the longer one follows, cut to a whole number."""
    h, w = image.shape[:2]
    to = (shorter * h // w, shorter) if w < h else (shorter, shorter * w // h)
    (y0, y1, fy), (x0, x1, fx) = _axis(h, to[0]), _axis(w, to[1])
    fy, fx = fy[:, None, None], fx[None, :, None]
    own = image.astype(np.float64)
    upper = own[y0][:, x0] * (1 - fx) + own[y0][:, x1] * fx
    lower = own[y1][:, x0] * (1 - fx) + own[y1][:, x1] * fx
    return np.clip(np.rint(upper * (1 - fy) + lower * fy), 0, 255).astype(np.uint8)


def centre_crop(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape[:2]
    if h < height or w < width:
        raise CorruptRecordError(f"the image is {h} x {w}, less than {height} x {width}")
    y, x = (h - height) // 2, (w - width) // 2
    return image[y : y + height, x : x + width]


def prepare(image: np.ndarray, p: ImageParams) -> np.ndarray:
    image = channels(image, p.image_dimensions[0])
    if p.resize:
        image = resize(image, p.resize)
    if p.to_rgb and image.shape[2] != 1:
        image = image[:, :, [2, 1, 0, 3][: image.shape[2]]]
    return centre_crop(image, *p.image_dimensions[1:])


def png_rows(data: bytes) -> tuple[np.ndarray, int] | None:
    """The rows of a plain PNG, a filter's number before each, and the channels; None of any other image."""
    at, body, head, kind = len(PNG), [], None, b""
    while data.startswith(PNG) and kind != b"IEND":
        if len(data) < at + 12:
            return None
        size, kind = struct.unpack_from(">I4s", data, at)
        own = data[at + 8 : at + 8 + size]
        if kind not in PNG_CHUNKS or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + own)):
            return None
        if kind == b"IDAT":
            body.append(own)
        elif kind == b"IHDR" and head is None and size == 13:
            head = struct.unpack(">IIBBBBB", own)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in PNG_CHANNELS or any(head[4:]) or not (head[0] and head[1]):
        return None
    width, height, n = head[0], head[1], PNG_CHANNELS[head[3]]
    size, packed = height * (1 + n * width), zlib.decompressobj()
    try:
        raw = packed.decompress(b"".join(body), size + 1)
    except zlib.error:
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1) if len(raw) == size and packed.eof else None
    return None if rows is None or rows[:, 0].max() > 2 else (rows, n)


def png_pixels(rows: np.ndarray, n: int) -> np.ndarray:
    """Pixels of png_rows as Spark's image source gives them: grey, or blue, green, red and opacity."""
    out = rows[:, 1:].reshape(len(rows), -1, n).copy()
    for y in np.flatnonzero(rows[:, 0]):
        if rows[y, 0] == 1:
            out[y] = np.cumsum(out[y], axis=0, dtype=np.uint8)
        elif y:
            out[y] += out[y - 1]
    return out if n == 1 else out[:, :, [2, 1, 0, 3][:n]]


def _way(images: pd.Series) -> pd.Series:
    def one(data) -> int:
        if data is None or not (data := bytes(data)).startswith(SIGNATURES):
            return NONE
        return BY_FILE if png_rows(data) is None else PLAIN

    return pd.Series([one(d) for d in images], dtype="int32")


def _unpacked(images: pd.Series) -> pd.DataFrame:
    def one(data) -> tuple:
        if data is None:
            return None, None, None, None, None, None
        own = png_pixels(*png_rows(bytes(data)))
        return None, *own.shape, (own.shape[2] - 1) * 8, np.ascontiguousarray(own).tobytes()

    out = pd.DataFrame([one(d) for d in images], columns=["origin", "height", "width", "nChannels", "mode", "data"])
    return out.astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")} | {"origin": "object"})


_way.__annotations__ = {"images": pd.Series, "return": pd.Series}
_unpacked.__annotations__ = {"images": pd.Series, "return": pd.DataFrame}


def _result(make) -> tuple:
    try:
        own = make()
    except (CorruptRecordError, NotSupportedError) as e:
        return None, None, None, None, str(e)
    return *own.shape, np.ascontiguousarray(own).tobytes(), None


def _decoded(p: ImageParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def own(h, w, n, data):
            if h is None or not h >= 1:
                raise CorruptRecordError("the image does not decode")
            return prepare(np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w), int(n)), p)

        for b in batches:
            rows = [_result(lambda r=r: own(*r)) for r in zip(b["height"], b["width"], b["nChannels"], b["data"], strict=True)]
            yield pd.DataFrame(rows, columns=["height", "width", "channels", "data", "why"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, OUT)


def read_images(spark: SparkSession, stores: list, params: ImageParams) -> DataFrame:
    """(__store_idx, __row_idx, __pos, __bytes, value: height, width, channels, data; __bad) in the order of the stores."""
    if params.image_frame == "recordio":
        told = read_records(spark, stores).withColumn("__bytes", F.octet_length("payload"))
        body = F.expr(f"substring(payload, {RECORD_HEADER + 1})")
        told = told.withColumn("image", body).transform(_decode)
    elif special(stores):
        held = with_store(contents(spark, stores), stores, F.col("path")).withColumn("__bytes", F.octet_length("content"))
        told = _one_a_store(held.withColumn("image", F.col("content"))).transform(_decode)
    else:
        files = _image_files(spark, list(dict.fromkeys(map(name_of, stores))))
        told = _one_a_store(with_store(files, stores, F.col("image.origin"))).withColumn("__bytes", F.octet_length("image.data"))
    told = told.withColumn("__m", _decoded(params)("image"))
    value = F.when(F.col("__m.why").isNull(), F.struct("__m.height", "__m.width", "__m.channels", "__m.data"))
    return told.select("__store_idx", "__row_idx", "__pos", "__bytes", value.alias("value"), F.col("__m.why").alias("__bad"))


def _one_a_store(df: DataFrame) -> DataFrame:
    return df.withColumn("__row_idx", F.lit(0).cast("long")).withColumn("__pos", F.col("__store_idx").cast("long"))


def _image_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    own = frozen(spark)
    own.conf.set("spark.sql.files.openCostInBytes", str(FILE_BYTES))
    return own.read.format("image").option("dropInvalid", False).load(paths)


def _decode(df: DataFrame) -> DataFrame:
    """df with the bytes in `image` decoded as Spark's image source does. Rows are written once and read in partitions that
    stay what they are. Each task of that read writes a file an image that is not a plain PNG, all in one folder, whose names
    tell the task and the row. A text file of one row is the row's bytes and a line end, which decoders leave unread."""
    spark = df.sparkSession
    rows, files = new_path(spark, "rows"), new_path(spark, "images")
    df.withColumn("__way", F.pandas_udf(_way, "int")("image")).write.parquet(rows)
    own = frozen(spark)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(PART_BYTES))  # a task writes a million files at most
    held = own.read.schema(StructType([*df.schema, StructField("__way", IntegerType())])).parquet(rows)
    plain = F.pandas_udf(_unpacked, IMAGE)(F.when(F.col("__way") == PLAIN, F.col("image")))
    left = held.where(F.col("__way") == BY_FILE)
    done = held.where(F.col("__way") != BY_FILE).withColumn("image", plain).drop("__way")
    if left.isEmpty():
        return done
    left.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(files)
    numbered = left.drop("image", "__way").withColumn("__mid", F.monotonically_increasing_id())
    name = lambda k: F.regexp_extract("image.origin", r"part-(\d+)-[^/]*-c(\d+)[.][^/]*$", k).cast("long")
    images = _image_files(spark, [files]).withColumn("__mid", F.shiftleft(name(1), 33) + name(2))
    return done.unionByName(numbered.join(images, "__mid", "left").drop("__mid"))
