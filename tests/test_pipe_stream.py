"""Pipes as streams: the batches are those of a reader of a file with the same bytes."""

import gzip
import random
import struct

import pytest
from pyspark.errors import StreamingQueryException
from test_formats import frame, message, tensor
from test_pipe_stores import feed

import rivulet as rv
from rivulet.errors import CorruptRecordError, NotSupportedError
from rivulet.sources.recordio import SEPARATOR, framed, records


def batches_of(spark, store, params, **how):
    """Rows of the batches of all micro-batches, and how many micro-batches had any."""
    held, filled = [], []

    def write(df, n):
        got = df.orderBy("batch_id").collect()
        held.extend(got)
        filled.extend([n] if got else [])

    query = rv.stream_batches(spark, store, write, params, **how)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return held, len(filled)


@pytest.mark.parametrize("last", list(rv.LastExampleHandling)[:3])
def test_lines(spark, tmp_path, last):
    text = "".join(f"line {i}\n" for i in range(1003))
    (tmp_path / "a.txt").write_text(text)
    name = feed(tmp_path, text.encode())
    params = rv.ReaderParams(batch_size=10, num_instances_to_skip=7, num_instances_to_read=905, num_shards=3, shard_index=1, last_example_handling=last)
    got, times = batches_of(spark, rv.PipeStore(name, 20), params, most=500)
    want = rv.TextLineReader(spark, [str(tmp_path / "a.txt")], params).batches().orderBy("batch_id").collect()
    assert got == want and times > 5


def test_csv(spark, tmp_path):
    """A header, comments, blank lines and rows that do not decode; a second pass through gzip."""
    body = "# a\nk,v,w\n" + "".join(f"{i},{'x' if i % 50 == 7 else i / 4},t{i}\n" + "\n# c\n" * (i % 9 == 0) for i in range(400))
    (tmp_path / "a.csv").write_text(body)
    name = feed(tmp_path, body.encode(), gzip.compress(body.encode()[:100]) + gzip.compress(body.encode()[100:]))
    csv = rv.CsvParams(column_names=("k", "v", "w"), column_types={"k": "int64", "v": "float64", "w": "string"}, comment_char="#", use_columns=frozenset(("k", "v")))
    params = rv.ReaderParams(batch_size=16, bad_example_handling=rv.BadExampleHandling.PAD)
    want = rv.CsvReader(spark, [str(tmp_path / "a.csv")], params, csv).batches().orderBy("batch_id").collect()
    got, times = batches_of(spark, rv.PipeStore(name, 20), params, csv_params=csv, most=300)
    assert got == want and times > 3 and sum(r["padding"] for r in got) == 8
    got, _ = batches_of(spark, rv.PipeStore(name, 20, compression="gzip"), params, csv_params=csv, number=1)
    assert got == want


def test_messages(spark, tmp_path):
    schema = rv.Schema((rv.Attribute("x", "float32", (2,)),))
    data = b"".join(frame(0, message([("x", tensor(2, [i, i + 0.5]))])) for i in range(90))
    (tmp_path / "a.rec").write_bytes(data)
    name = feed(tmp_path, data)
    params = rv.ReaderParams(batch_size=8)
    want = rv.TensorRecordReader(spark, [str(tmp_path / "a.rec")], params, schema).batches().orderBy("batch_id").collect()
    got, times = batches_of(spark, rv.PipeStore(name, 20), params, schema=schema, most=400)
    assert got == want and times > 2 and len(got) == 12


def test_framed_as_it_comes():
    """Records of any kind, cut anywhere, as from the bytes as a whole."""
    rng = random.Random(4)
    head = lambda kind, n: SEPARATOR + struct.pack("<I", kind << 29 | n)
    data = b""
    for i in range(60):
        for kind in rng.choice(([0], [1, 3], [1, 2, 2, 3])):
            own = rng.choice((b"", SEPARATOR, rng.randbytes(rng.randrange(40))))
            data += head(kind, len(own)) + own + bytes(-len(own) % 4)
    for most in (1, 3, 17, 10_000):
        cut, parts = 0, []
        while cut < len(data):
            n = rng.randint(1, most)
            parts.append(data[cut : cut + n])
            cut += n
        assert list(framed(iter(parts))) == list(records(data))
    for broken in (data + head(1, 0), head(3, 0), data + head(2, 4) + b"1234"):
        with pytest.raises(CorruptRecordError):
            list(framed(iter([broken])))


def test_empty_and_refused(spark, tmp_path):
    name = feed(tmp_path, b"", b"a\n")
    with pytest.raises(StreamingQueryException, match="nothing came out"):
        batches_of(spark, rv.PipeStore(name, 1), rv.ReaderParams(batch_size=2))
    with pytest.raises(NotSupportedError):
        rv.stream_csv(spark, rv.PipeStore(name), rv.CsvParams())
    for wrong in ({"sample_ratio": 0.5}, {"shuffle_instances": True}):
        with pytest.raises(NotSupportedError):
            rv.stream_batches(spark, rv.PipeStore(name), print, rv.ReaderParams(batch_size=2, **wrong))


def test_a_pipe_is_not_read_twice(spark, tmp_path):
    """A query that goes on from a checkpoint finds another pipe, or none, where it stood."""
    name = feed(tmp_path, b"a\nb\n", b"c\n")
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    own = lambda number: rv.stream_pipe(spark, rv.PipeStore(name, 5), number).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
    query = own(0)
    query.processAllAvailable()
    query.stop()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    query = own(1)  # the offset says that the pipe has ended
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == 2
