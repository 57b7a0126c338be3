"""Pipes in the lists of stores of readers: files in the shared folder, one for each pass."""

import gzip
import os
import threading

import numpy as np
import pytest
from test_formats import frame, message, png, tensor

import rivulet as rv
from rivulet.sources import images, pipes


def feed(tmp_path, *passes):
    """A pipe of these bytes, pass after pass, each in two writes."""
    name = str(tmp_path / "pipe")

    def write(n, data):
        with open(f"{name}_{n}", "wb") as f:
            f.write(data[: len(data) // 2])
            f.flush()
            f.write(data[len(data) // 2 :])

    for n, data in enumerate(passes):
        os.mkfifo(f"{name}_{n}")
        threading.Thread(target=write, args=(n, data), daemon=True).start()
    return name


def test_spooled_bytes(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = [b"a\r\nb\n", b"a\nb", bytes(range(256)), bytes(1000), rng.integers(0, 256, 3_000_000, np.uint8).tobytes() + b"\xff", b"x" * 2_500_000 + b"\0"]
    name = feed(tmp_path, *held)
    for n, data in enumerate(held):
        file = pipes.spool(spark, pipes.PipeStore(name, 20), n)
        assert bytes(spark.read.format("binaryFile").load(file).first()["content"]) == data


def test_csv(spark, tmp_path):
    """The same rows as from files; samples and full shuffles, which lines of a pipe as they come do not allow."""
    text = "".join(f"{i},{i % 7}\n" for i in range(500))
    second = gzip.compress(b"k,v\n" + b"".join(b"%d,1\n" % i for i in range(900)))
    (tmp_path / "a.csv").write_text("k,v\n" + text)
    name = feed(tmp_path, ("k,v\n" + text).encode())
    params = rv.ReaderParams(batch_size=32, sample_ratio=0.5, shuffle_instances=True, shuffle_seed=3)
    got = list(rv.CsvReader(spark, [pipes.PipeStore(name, 20)], params))
    want = list(rv.CsvReader(spark, [str(tmp_path / "a.csv")], params))
    assert [e["k"] for e in got] == [e["k"] for e in want] and sum(len(e["k"]) for e in got) == 250
    (tmp_path / "g").mkdir()
    packed = feed(tmp_path / "g", second)
    both = rv.CsvReader(spark, [str(tmp_path / "a.csv"), pipes.PipeStore(packed, 20, compression="gzip")], rv.ReaderParams(batch_size=1400))
    (batch,) = list(both)
    assert batch["k"] == [*range(500), *range(900)]


def test_passes(spark, tmp_path):
    name = feed(tmp_path, b"k\n1\n2\n", b"k\n3\n")
    reader = rv.CsvReader(spark, [pipes.PipeStore(name, 20)], rv.ReaderParams(batch_size=5))
    assert [e["k"] for e in reader] == [[1, 2]]
    reader.reset()
    assert [e["k"] for e in reader] == [[3]]


def test_records_and_images(spark, tmp_path):
    data = b"".join(frame(0, message([("x", tensor(2, [i, i + 1]))])) for i in range(40))
    reader = rv.TensorRecordReader(spark, [pipes.PipeStore(feed(tmp_path, data), 20)], rv.ReaderParams(batch_size=40))
    assert next(iter(reader))["x"] == [[i, i + 1] for i in range(40)]
    (tmp_path / "i").mkdir()
    framed = b"".join(frame(0, bytes(24) + png(np.full((4, 4, 3), k, np.uint8))) for k in (5, 9))
    reader = rv.ImageReader(spark, [pipes.PipeStore(feed(tmp_path / "i", framed), 20)], rv.ReaderParams(batch_size=2), images.ImageParams((3, 4, 4), "recordio"))
    assert [set(bytes(v["data"])) for v in next(iter(reader))["value"]] == [{5}, {9}]


def test_errors(spark, tmp_path):
    with pytest.raises(rv.NotSupportedError):
        pipes.PipeStore("p", compression="infer")
    with pytest.raises(rv.StreamError):
        rv.CsvReader(spark, [pipes.PipeStore(str(tmp_path / "none"), 1)]).read_example()
