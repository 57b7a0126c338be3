"""Tensor records, sparse batches, images, pipes, whole-file text, the register sketch and the adapters."""

import math
import os
import struct
import threading
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.errors import CorruptRecordError, InflateError, SchemaError, StreamError
from rivulet.operators import sketch, sparse
from rivulet.operators.position import with_position
from rivulet.params import CsvParams
from rivulet.schema import Attribute, Schema, default_strides
from rivulet.sources import csv, images, lines, pipes, protobuf, stores
from rivulet.streaming import adapters

from test_readers import frame, write


def varint(n):
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number, raw):
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def tensor(kind, values, keys=(), shape=()):
    if kind == protobuf.INT32:
        raw = b"".join(varint(v & (1 << 64) - 1) for v in values)
    else:
        raw = np.asarray(values, protobuf.KINDS[kind][1]).tobytes()
    parts = field(1, raw) + (field(2, b"".join(map(varint, keys))) if keys else b"") + (field(3, b"".join(map(varint, shape))) if shape else b"")
    return field(kind, parts)


def message(features, labels=()):
    entry = lambda name, value: field(1, name.encode()) + field(2, value)
    return b"".join(field(1, entry(*f)) for f in features) + b"".join(field(2, entry(*f)) for f in labels)


def test_varints():
    values = [0, 1, 127, 128, 300, 2**32, 2**64 - 1]
    assert protobuf.varints(b"".join(map(varint, values))).tolist() == values
    with pytest.raises(CorruptRecordError):
        protobuf.varints(b"\x80")


def test_dense_records(spark, tmp_path):
    row = lambda x, y: message([("x", tensor(2, x)), ("m", tensor(3, [1, 2, 3, 4, 5, 6], shape=(2, 3)))], [("y", tensor(7, [y]))])
    paths = write(tmp_path, a__rec=frame(0, row([1, 2], -7)) + frame(0, row([3, 4, 5], 1)) + frame(0, b"\xff"), b__rec=frame(0, row([6, 7], 2**31 - 1)))
    got = protobuf.read_protobuf(spark, paths)
    assert got.schema["m"].metadata["shape"] == [2, 3]
    rows = got.orderBy("__pos").collect()
    assert [(r["x"], r["label_y"], r["__pos"], r["__store_idx"], r["__row_idx"]) for r in rows] == [([1, 2], [-7], 0, 0, 0), (None, None, 1, 0, 1), (None, None, 2, 0, 2), ([6, 7], [2**31 - 1], 3, 1, 0)]
    assert rows[1]["__bad"] == "x has another shape" and rows[2]["__bad"] and rows[0]["__bad"] is None


def test_sparse_records(spark, tmp_path):
    row = lambda values, keys: message([("s", tensor(2, values, keys, (3, 4)))])
    paths = write(tmp_path, a__rec=frame(0, row([1.5, 2.5], [1, 11])) + frame(0, row([], [])) + frame(0, row([9], [5])) + frame(0, row([1], [12])))
    got = protobuf.read_protobuf(spark, paths)
    assert [r["__bad"] for r in got.orderBy("__pos").collect()] == [None, None, None, "s has a key out of range"]
    batch = sparse.coo_batches(got.where("__bad is null"), "s", (3, 4), 4).first()
    assert batch["shape"] == [3, 3, 4] and batch["data"] == [1.5, 2.5, 9] and batch["coords"] == [[0, 0, 2], [0, 2, 1], [1, 3, 1]]
    one = got.limit(1).select(F.transform("s.keys", lambda k: sparse.coordinates(k, (3, 4))).alias("c")).first()
    assert one["c"] == [[0, 1], [2, 3]]


def test_record_schema():
    with pytest.raises(SchemaError):
        protobuf.infer_schema(message([("s", tensor(2, [1], [0]))]))
    assert protobuf.infer_schema(message([("s", tensor(3, [], [], (5,)))])).attributes[0].sparse
    with pytest.raises(ValueError, match="not unique"):
        Schema((Attribute("a", "int8"), Attribute("a", "int8")))
    with pytest.raises(ValueError, match="strides"):
        Attribute("a", "int8", (2, 3), (1,))
    assert default_strides((2, 3, 4)) == (12, 4, 1) and Schema((Attribute("a", "int8"),)).get_index("b") is None


def test_csr():
    data, indices, indptr = sparse.to_csr(np.array([3, 1, 2]), np.array([2, 0, 2]), np.array([1, 4, 0]), 4)
    assert data.tolist() == [1, 2, 3] and indices.tolist() == [4, 0, 1] and indptr.tolist() == [0, 1, 1, 3, 3]


def png(pixels, filters=(0, 1, 2, 3, 4)):
    """Encodes rows x columns x channels (red first), each line with another filter."""
    h, w, n = pixels.shape
    out, above = b"", [0] * (w * n)
    for y in range(h):
        line, kind = pixels[y].reshape(-1).tolist(), filters[y % len(filters)]
        own = []
        for i, v in enumerate(line):
            a, b, c = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            own.append(v - (0, a, b, (a + b) // 2, paeth)[kind] & 255)
        out, above = out + bytes([kind, *own]), line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def jpeg(spark, height, width, value):
    """A grey image, by the JVM's encoder."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 5)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, value << 16 | value << 8 | value)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def test_images_in_records(spark, tmp_path):
    """Grey, colour and transparent PNG images, a JPEG, junk, nothing, and one image twice."""
    rng = np.random.default_rng(4)
    pixels = {n: rng.integers(0, 256, (11, 7, n), np.uint8) for n in (1, 3, 4)}
    pixels[4][:, :, 3] = 255
    held = [png(pixels[1]), png(pixels[3]), png(pixels[4]), jpeg(spark, 12, 9, 100), b"junk", b"", png(pixels[3])]
    (path,) = write(tmp_path, a__rec=b"".join(frame(0, bytes(24) + d) for d in held))
    rows = images.read_images(spark, [path], images.ImageParams((3, 11, 7), "recordio", to_rgb=True)).orderBy("__pos").collect()
    assert [r["__bad"] is None for r in rows] == [True, True, True, True, False, False, True] and [r["__pos"] for r in rows] == list(range(7))
    got = [np.frombuffer(r["value"]["data"], np.uint8).reshape(11, 7, 3) for r in rows if r["value"]]
    assert (got[0] == pixels[1]).all() and (got[1] == pixels[3]).all() and (got[2] == pixels[4][:, :, :3]).all() and (got[4] == pixels[3]).all()
    assert np.abs(got[3].astype(int) - 100).max() <= 2
    empty = write(tmp_path, e__rec=b"")[-1]
    assert images.read_images(spark, [empty], images.ImageParams((3, 1, 1), "recordio")).count() == 0


def test_images(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (10, 14, 3), np.uint8)
    paths = write(tmp_path, i10__png=png(pixels[:4, :5]), i2__png=png(pixels), i3__png=b"junk")
    p = images.ImageParams((3, 6, 8), to_rgb=True)
    rows = images.read_images(spark, paths, p).orderBy("__pos").collect()
    assert [r["__store_idx"] for r in rows] == [0, 1, 2] and [r["__bad"] is None for r in rows] == [True, False, False]
    v = rows[0]["value"]
    assert (np.frombuffer(v["data"], np.uint8).reshape(6, 8, 3) == pixels[2:8, 3:11]).all()
    (tmp_path / "r").mkdir()
    framed = write(tmp_path / "r", a__rec=b"".join(frame(0, bytes(24) + d) for d in (png(pixels), b"junk")))
    rows = images.read_images(spark, framed, images.ImageParams((3, 6, 8), "recordio", to_rgb=True)).orderBy("__pos").collect()
    assert rows[0]["value"]["data"] == v["data"] and rows[1]["__bad"]
    grey = images.prepare(pixels, images.ImageParams((1, 5, 5), resize=5))
    assert grey.shape == (5, 5, 1)
    flat = np.full((9, 6, 3), 77, np.uint8)
    assert images.resize(flat, 4).shape == (6, 4, 3) and (images.resize(flat, 4) == 77).all()
    with pytest.raises(ValueError, match="image_dimensions"):
        images.ImageParams((3, 6))


FIELD = st.text(st.sampled_from('ab,"\n\r #'), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=1, max_size=3), min_size=1, max_size=4))
def test_quoted_records(table):
    text = "\n".join(",".join('"' + f.replace('"', '""') + '"' for f in row) for row in table)
    assert [csv.tokenize(r) for r in csv.quoted_records()(text)] == table


def test_quoted_line_ends(spark, tmp_path):
    paths = write(tmp_path, a__csv='n,s\n#"\n1,"a\r\nb"\n\n2,x"y\n', b__csv='n,s\n3,"""\n"\n')
    p = CsvParams(comment_char="#", allow_quoted_new_lines=True)
    rows = csv.read_csv(spark, paths, p).orderBy("__pos").collect()
    assert [(r["n"], r["s"], r["__pos"], r["__bad"]) for r in rows] == [(1, "a\r\nb", 0, None), (2, 'x"y', 1, None), (3, '"\n', 2, None)]


def test_marks_and_inflation(spark, tmp_path):
    text = "é1\nж2\n"
    data = {"utf16 le": "﻿".encode("utf-16-le") + text.encode("utf-16-le"), "utf16be": "﻿".encode("utf-16-be") + text.encode("utf-16-be"), "utf32": text.encode("utf-32"), "utf8": text.encode("utf-8-sig")}
    paths = write(tmp_path, **{k + "__txt": v for k, v in data.items()})
    got = lines.read_lines(spark, paths).orderBy("__pos").collect()
    assert [r["value"] for r in got] == ["é1", "ж2"] * 4 and [r["__pos"] for r in got] == list(range(8))
    (tmp_path / "z").mkdir()
    packed = write(tmp_path / "z", a__bin=zlib.compress(b"a\n") + zlib.compress(b"b"), c__bin=b"")
    assert [r["value"] for r in lines.read_lines(spark, packed, compression="gzip").orderBy("__pos").collect()] == ["a", "b"]
    with pytest.raises(InflateError):
        stores.inflate(zlib.compress(b"abc")[:-3])
    with pytest.raises(StreamError):
        lines.decode(b"\xff", "utf-8")


def test_names_with_spaces(spark, tmp_path):
    paths = write(tmp_path, **{"a b__txt": "1\n", "c%20d__txt": "2\n"})
    assert [r["value"] for r in lines.read_lines(spark, paths).orderBy("__pos").collect()] == ["1", "2"]


def test_objects_and_buffers(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write(tmp_path, f10__csv="", f2__csv="")
    write(tmp_path / "x", f1__txt="")
    found = stores.list_objects(spark, str(tmp_path), predicate=lambda p: "txt" not in p)
    assert [p.rsplit("/", 1)[1] for p in found] == ["f2.csv", "f10.csv"]
    assert [bytes(r["content"]) for r in stores.in_memory(spark, [b"a", b""]).orderBy("__store_idx").collect()] == [b"a", b""]


def test_pipe(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in range(2):
        os.mkfifo(f"{path}_{n}")

        def put(n=n):
            with open(f"{path}_{n}", "wb") as f:
                f.write(b"a\r\nb\n\n" + b"last%d" % n)

        writer = threading.Thread(target=put, daemon=True)
        writer.start()
        rows = pipes.read_pipe(spark, path, n, 20).collect()
        writer.join()
        assert [(r["value"], r["__pos"]) for r in rows] == [("a", 0), ("b", 1), ("", 2), (f"last{n}", 3)]
    with pytest.raises(StreamError):
        list(pipes.chunks(f"{path}_7", 0.1))
    with pytest.raises(StreamError):
        list(pipes.chunks(f"{path}_0", 0.1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5).map(lambda b: b.translate(bytes(10 if c % 3 == 0 else 13 if c % 3 == 1 else 97 for c in range(256))))))
def test_pipe_lines(parts):
    assert list(pipes.lines(iter(parts))) == b"".join(parts).splitlines(keepends=True)


def test_sketch(spark):
    import xxhash

    values = [f"v{i}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values * 2] + [("",), (None,)], "v string")
    top = {}
    for v in values:
        h = xxhash.xxh32_intdigest(v)
        top[h >> 16] = max(top.get(h >> 16, 0), 16 - (h & 0xFFFF).bit_length() + 1)
    own = sketch.registers(df, "v")
    assert {r["register"]: r["rank"] for r in own.collect()} == top
    halves = sketch.merge(sketch.registers(df.limit(2000), "v"), own)
    got = sketch.estimate(halves).first()[0]
    assert math.isclose(got, 65536 * math.log(65536 / (65536 - len(top)))) and abs(got - 3000) < 60
    assert sketch.estimate(sketch.registers(df.where("v = ''"), "v")).first()[0] == 0


def test_adapters(spark):
    df = with_position(spark.range(4).selectExpr("id as k", "named_struct('keys', array(id), 'values', array(id + 0.5d)) as s"), "k")
    batch = sparse.coo_batches(df, "s", (4,), 4).first()
    assert adapters.as_numpy(batch, "data").tolist() == [0.5, 1.5, 2.5, 3.5]
    assert adapters.to_tensor(np.zeros((2, 3))).strides == (3, 1)
    assert adapters.as_arrow_file(b"abc").read() == b"abc" and adapters.as_dlpack(np.ones(2)) is not None
    with pytest.raises(Exception, match="no such form"):
        adapters.as_dlpack(np.array(["a"]))
