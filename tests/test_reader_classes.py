"""Whole readers: files through the row operators to batches, epochs and errors."""

import gzip
import io
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import rivulet as rv
from rivulet.operators import rows
from rivulet.operators.position import POS

from test_formats import message, png, tensor
from test_readers import frame, write


def values(reader, name):
    return [v for e in reader for v in e[name]]


def test_csv_reader(spark, tmp_path):
    paths = write(tmp_path, f10__csv="a,b\n5,z\n6,y\n", f2__csv="a,b\n1,p\n2,q\n3,r\n4,s\n")
    reader = rv.CsvReader(spark, paths, rv.ReaderParams(batch_size=4, last_example_handling=rv.LastExampleHandling.PAD))
    assert [(f.name, f.dataType.simpleString()) for f in reader.read_schema()] == [("a", "bigint"), ("b", "string")]
    assert reader.peek_example()["a"] == [1, 2, 3, 4]
    batches = list(reader)
    assert [(e["a"], e["b"], e["padding"]) for e in batches] == [([1, 2, 3, 4], ["p", "q", "r", "s"], 0), ([5, 6, 0, 0], ["z", "y", "", ""], 2)]
    assert reader.read_example() is None
    reader.reset()
    assert values(reader, "a") == [1, 2, 3, 4, 5, 6, 0, 0]
    part = rv.CsvReader(spark, paths, rv.ReaderParams(num_instances_to_skip=1, num_shards=2, shard_index=1))
    assert values(part, "a") == [3, 5]


def test_bad_rows(spark, tmp_path):
    paths = write(tmp_path, a__csv="a,b\n1,1\n2\n3,x\n4,4\n5,5\n")
    read = lambda how: rv.CsvReader(spark, paths, rv.ReaderParams(batch_size=2, bad_example_handling=how))
    with pytest.raises(rv.InvalidInstanceError):
        list(read(rv.BadExampleHandling.ERROR))
    assert values(read(rv.BadExampleHandling.SKIP), "a") == [5]
    assert [(e["a"], e["padding"]) for e in read(rv.BadExampleHandling.PAD)] == [([1, 0], 1), ([4, 0], 1), ([5], 0)]


@pytest.mark.parametrize("window", [0, 1, 4])
def test_epochs(spark, tmp_path, window):
    paths = write(tmp_path, a__txt="".join(f"{i}\n" for i in range(50)))
    reader = rv.TextLineReader(spark, paths, rv.ReaderParams(batch_size=8, shuffle_instances=True, shuffle_window=window, shuffle_seed=3))
    first = values(reader, "value")
    reader.reset()
    second = values(reader, "value")
    assert sorted(map(int, first)) == sorted(map(int, second)) == list(range(50))
    assert (first == second) == (window == 1)
    if window == 4:
        assert all(int(v) <= i + 3 for i, v in enumerate(first))
        assert any(int(v) // 4 != i // 4 for i, v in enumerate(first))


def test_shuffled_positions_are_dense(spark):
    df = spark.range(1000).withColumn(POS, F.col("id"))
    for window in (0, 7):
        got = rows.shuffled(df, 1, window).orderBy(POS).collect()
        assert [r[POS] for r in got] == list(range(1000)) and [r["id"] for r in got] != list(range(1000))
        assert [r["id"] for r in rows.shuffled(df, 1, window, epoch=5, reshuffle=False).orderBy(POS).collect()] == [r["id"] for r in got]


def test_records_and_images(spark, tmp_path):
    row = lambda x: frame(0, message([("x", tensor(2, x)), ("s", tensor(2, x[:1], [3], (4,)))]))
    records = write(tmp_path, a__rec=row([1, 2]) + row([3, 4]) + row([5, 6]))
    pad = rv.ReaderParams(batch_size=2, last_example_handling=rv.LastExampleHandling.PAD)
    last = list(rv.TensorRecordReader(spark, records, pad))[1]
    assert last["x"] == [[5, 6], [0, 0]] and [(r["keys"], r["values"]) for r in last["s"]] == [([3], [5]), ([], [])]
    (tmp_path / "i").mkdir()
    paths = write(tmp_path / "i", a__png=png(np.full((4, 4, 3), 9, np.uint8)))
    own = next(iter(rv.ImageReader(spark, paths, pad, rv.ImageParams((3, 2, 2)))))
    assert [bytes(v["data"]) for v in own["value"]] == [bytes([9] * 12), bytes(12)]
    with pytest.raises(ValueError, match="image_dimensions"):
        rv.ImageReader(spark, paths)


def noted():
    out = []
    rv.set_log_handler(lambda level, message: out.append((level, message)))
    return out


@pytest.fixture
def log():
    yield noted()
    rv.set_log_handler(None)
    rv.set_log_level(rv.LogLevel.WARNING)


def test_warnings_tell_what_happened(spark, tmp_path, log):
    paths = write(tmp_path, a__csv="a,b\n1,1\n2\n3,x\n4,4\n5,5\n6,6\n7,7\n")
    bad, last = rv.BadExampleHandling, rv.LastExampleHandling

    def read(on_bad, on_last=last.NONE, **more):
        log.clear()
        reader = rv.CsvReader(spark, paths, rv.ReaderParams(batch_size=2, bad_example_handling=on_bad, last_example_handling=on_last, **more))
        return [e["a"] for e in reader], [m for _, m in log]

    assert read(bad.SKIP_WARN) == ([[5, 6], [7]], ["batch 0 is skipped, as rows of it are bad", "batch 1 is skipped, as rows of it are bad"])
    assert read(bad.PAD_WARN, last.DROP_WARN) == (
        [[1, 0], [4, 0], [5, 6]], ["batch 0 is padded, as rows of it are bad", "batch 1 is padded, as rows of it are bad", "batch 3 is dropped, as it is short"])
    assert read(bad.SKIP, last.PAD_WARN) == ([[5, 6], [7, 0]], ["batch 3 is padded, as it is short"])
    assert read(bad.SKIP, warn_bad_instances=True)[1] == ["row 1: 1 fields instead of 2", "row 2: b is not int64: 'x'"]
    rv.set_log_level(rv.LogLevel.OFF)
    assert read(bad.SKIP_WARN)[1] == [] and rv.get_log_level() is rv.LogLevel.OFF
    rv.set_log_level(rv.LogLevel.WARNING)
    whole = write(tmp_path, b__csv="a,b\n1,1\n2,2\n")[1:]
    log.clear()
    calm = rv.ReaderParams(batch_size=2, bad_example_handling=bad.PAD_WARN, last_example_handling=last.DROP_WARN)
    assert len(list(rv.CsvReader(spark, whole, calm))) == 1 and log == []
    cut = rv.CsvParams(max_field_length=2, max_field_length_handling=rv.MaxFieldLengthHandling.TRUNCATE_WARN, default_data_type="string")
    long = write(tmp_path, c__csv="a,b\nxyz,1\n")[2:]
    assert [e["a"] for e in rv.CsvReader(spark, long, None, cut)] == [["xy"]] and [m for _, m in log] == ["row 0: a field was cut"]


def test_faults_stay_until_reset(spark, tmp_path):
    paths = write(tmp_path, a__csv="a,b\n1,1\n2,2\n3\n")
    reader = rv.CsvReader(spark, paths)
    with pytest.raises(rv.InvalidInstanceError, match="row 2: 1 fields instead of 2") as first:
        list(reader)
    for step in (reader.read_example, reader.peek_example):
        with pytest.raises(rv.InvalidInstanceError) as again:
            step()
        assert again.value is first.value
    reader.reset()
    assert reader.peek_example()["a"] == [1] and reader.num_bytes_read == 0


def test_errors_of_tasks_keep_their_kind(spark, tmp_path):
    paths = write(tmp_path, a__rec=frame(0, b"x") + frame(2, b"y"))
    reader = rv.TensorRecordReader(spark, paths, schema=rv.Schema([rv.Attribute("x", "float32")]))
    for _ in range(2):
        with pytest.raises(rv.CorruptRecordError, match="record #1 .*a.rec"):
            reader.read_example()
    long = write(tmp_path, b__txt="short\n" + "x" * 50)[1:]
    with pytest.raises(rv.RecordTooLargeError) as over:
        list(rv.TextLineReader(spark, long, max_line_length=20))
    assert over.value.__cause__ is not None
    wrong = write(tmp_path, c__txt=b"\xff\xfe\xfa")[2:]
    with pytest.raises(rv.StreamError):
        list(rv.TextLineReader(spark, wrong, encoding="ascii"))
    with pytest.raises(rv.InflateError):
        list(rv.TextLineReader(spark, wrong, compression="gzip"))
    with pytest.raises(rv.NotSupportedError):
        rv.CsvParams(number_base=16)


def test_stores(spark, tmp_path):
    class Squares(rv.DataStore):
        id = "squares"

        def open_read(self):
            return rv.InputStream(io.BytesIO(b"1\n4\n9"))

    (path,) = write(tmp_path, packed=gzip.compress(b"a\nb\n"))
    memory = rv.InMemoryStore(b"m\n")
    reader = rv.TextLineReader(spark, [memory, Squares(), rv.File(path, "gzip"), memory], rv.ReaderParams(batch_size=20))
    assert next(iter(reader))["value"] == ["m", "1", "4", "9", "a", "b", "m"]
    assert reader.num_bytes_read == 7
    with pytest.raises(ValueError, match="path"):
        rv.File("folder/")
    for make in (lambda: rv.InMemoryStore(b"", "infer"), lambda: rv.File("a", "zip"), lambda: rv.File("a", "bzip2")):
        with pytest.raises(rv.NotSupportedError):
            make()
    with Squares().open_read() as stream:
        assert stream.read(1) == b"1" and stream.seek(0) == 0 and stream.tell() == 0 and stream.readinto(bytearray(2)) == 2
    for step in (stream.read, stream.tell, lambda: stream.seek(0)):
        with pytest.raises(rv.StreamError):
            step()


def test_stores_of_records_and_images(spark, tmp_path):
    import pyarrow.parquet as pq

    from rivulet.sources import parquet_stream, recordio
    from rivulet.streaming import adapters
    from test_formats import png

    held = recordio.read_records(spark, [rv.InMemoryStore(gzip.compress(frame(0, b"one") + frame(0, b"two")), "gzip")])
    records = rv.Records(held)
    assert bytes(records.peek_record()["payload"]) == bytes(records.read_record()["payload"]) == b"one"
    assert [bytes(r["payload"]) for r in records] == [b"two"] and records.read_record() is None
    image = rv.ImageReader(spark, [rv.InMemoryStore(png(np.full((4, 4, 3), 9, np.uint8)))], None, rv.ImageParams((3, 2, 2)))
    assert bytes(next(iter(image))["value"][0]["data"]) == bytes([9] * 12)
    out = tmp_path / "t.parquet"
    spark.range(5).coalesce(1).toPandas().to_parquet(out)
    data = out.read_bytes()
    for store in (data, str(out), rv.File(str(out)), rv.InMemoryStore(data), rv.InMemoryStore(gzip.compress(data), "gzip")):
        assert pq.read_table(adapters.as_arrow_file(store)).num_rows == 5
    assert parquet_stream.read_parquet_stream(spark, [rv.InMemoryStore(data * 2)]).count() == 2


def test_examples_are_mappings(spark, tmp_path):
    paths = write(tmp_path, a__csv="a,b\n1,x\n2,y\n")
    example = rv.CsvReader(spark, paths, rv.ReaderParams(batch_size=2)).read_example()
    assert len(example) == 2 and list(example) == ["a", "b"] and "a" in example and "size" not in example
    assert example[0] == example["a"] == [1, 2] and example[-1] == ["x", "y"] and dict(example.items())["b"] == ["x", "y"]
    assert (example.batch_id, example.size, example["padding"]) == (0, 2, 0) and "features" in repr(example)
    for key in (2, "z"):
        with pytest.raises(KeyError):
            example[key]


def test_tensors():
    from rivulet.streaming import adapters

    dense = rv.DenseTensor((2, 3), range(6))
    assert dense.numpy().tolist() == [[0, 1, 2], [3, 4, 5]] and dense.strides == (3, 1)
    assert rv.DenseTensor((3, 2), range(6), strides=(1, 3)).numpy().tolist() == [[0, 3], [1, 4], [2, 5]]
    coo = rv.CooTensor((2, 4), [5.0, 6.0, 7.0], [[1, 0, 1], [3, 2, 0]])
    assert coo.indices(1).tolist() == [3, 2, 0] and coo.dense().tolist() == [[0, 0, 6, 0], [7, 0, 0, 5]]
    assert [x.tolist() for x in coo.csr()] == [[6, 7, 5], [2, 0, 3], [0, 1, 3]]
    for make in (lambda: rv.DenseTensor((2, 3), range(5)), lambda: rv.DenseTensor((2,), [1, 2], (1, 1)), lambda: rv.CooTensor((2,), [1], [[2]]), lambda: rv.CooTensor((2, 2), [1], [[0]])):
        with pytest.raises(ValueError):
            make()
    assert adapters.to_tensor(np.ones((2, 2))).shape == (2, 2)
    assert adapters.as_dlpack(np.ones(3)) is not None
    with pytest.raises(rv.NotSupportedError):
        adapters.as_dlpack(np.ones(3), 0x20)
    with pytest.raises(rv.NotSupportedError):
        adapters.as_dlpack(np.array(["a"]))


def test_analysis(spark, tmp_path):
    paths = write(tmp_path, a__csv="a,b\nx y,1\n,2.5\nx,NA\n")
    reader = rv.CsvReader(spark, paths, None, rv.CsvParams(default_data_type="string"))
    own = rv.analyze_dataset(reader, null_like_values=["na"], capture_columns=[0], max_capture_count=1)
    a, b = own.columns
    assert repr(a) == "ColumnAnalysis(a)" and a.rows_seen == 3 and a.example_value == "x y" and a.string_min_length_not_empty == 1
    assert a.string_captured_unique_values == {"x y": 1} and a.string_captured_unique_values_overflowed
    assert a.estimate_string_vocab_cardinality() == 2 and b.estimate_string_cardinality() == 3
    told = b.to_dict()
    assert (told["rows_seen"], told["numeric_finite_mean"], told["string_null_like_count"], told["numeric_finite_median_approx"]) == ("3", "1.750000", "1", 2.5)
    with pytest.raises(rv.SchemaError):
        rv.analyze_dataset(rv.CsvReader(spark, paths))
    with pytest.raises(rv.SchemaError):
        rv.analyze_dataset(rv.TextLineReader(spark, write(tmp_path, z__txt="")[1:]))


def test_pipe_reader(spark, tmp_path):
    name = str(tmp_path / "pipe")
    for n, data in enumerate((b"a\nb\n", gzip.compress(b"c\nd\n"))):
        os.mkfifo(f"{name}_{n}")

    def feed(n, data):
        with open(f"{name}_{n}", "wb") as f:
            f.write(data)

    for n, data, kind in ((0, b"a\nb\n", "none"), (1, gzip.compress(b"c\n") + gzip.compress(b"d\n"), "gzip")):
        thread = threading.Thread(target=feed, args=(n, data))
        thread.start()
        reader = rv.PipeReader(spark, name, rv.ReaderParams(batch_size=5), timeout=20, fifo_id=n, compression=kind)
        assert next(iter(reader))["value"] == (["a", "b"] if n == 0 else ["c", "d"])
        thread.join()
    with pytest.raises(rv.StreamError):
        rv.PipeReader(spark, str(tmp_path / "none"), timeout=1).read_example()
    for params in (rv.ReaderParams(shuffle_instances=True), rv.ReaderParams(sample_ratio=0.5)):
        with pytest.raises(rv.NotSupportedError):
            rv.PipeReader(spark, name, params)
