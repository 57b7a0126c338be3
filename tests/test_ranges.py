"""Files cut by byte ranges: results are those of reading each whole, however Spark splits them."""

import struct

import numpy as np
import pytest

from rivulet.errors import CorruptHeaderError, CorruptRecordError, translated
from rivulet.sources import quoted, recordio
from rivulet.sources.recordio import MAGIC, read_records, records


def frame(payload, kind=0):
    return struct.pack("<II", MAGIC, kind << 29 | len(payload)) + payload + b"\0" * (-len(payload) % 4)


def _random_file(rng, n):
    """Whole and split records, some with the magic, or a whole file of frames, as payload."""
    magic, out = struct.pack("<I", MAGIC), []

    def payload():
        kind = rng.integers(0, 6)
        some = rng.bytes(int(rng.integers(0, 90)))
        return [some, b"", magic, some + magic + some, frame(some) + frame(b"x"), some + magic][kind]

    for _ in range(n):
        if rng.random() < 0.5:
            out.append(frame(payload()))
        else:
            parts = int(rng.integers(0, 6))
            out += [frame(payload(), 1), *(frame(payload(), 2) for _ in range(parts)), frame(payload(), 3)]
    return b"".join(out)


@pytest.fixture
def splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [500, 5000])
def test_split_records_and_magic_in_payloads_over_many_splits(spark, tmp_path, splits, size):
    rng = np.random.default_rng(size)
    datas = [_random_file(rng, 12), b"", _random_file(rng, 3), frame(b"plain") * 10, _random_file(rng, 10) + frame(b"end" + struct.pack("<I", MAGIC) * 2, 0)]
    files = []
    for i, data in enumerate(datas):
        (tmp_path / f"f{i}.rec").write_bytes(data)
        files.append(str(tmp_path / f"f{i}.rec"))
    files.append(files[0])
    want = [(i, n, p) for i, f in enumerate([*datas, datas[0]]) for n, p in enumerate(records(f))]
    splits(size)
    found = read_records(spark, files)
    rows = sorted((r["__store_idx"], r["__row_idx"], bytes(r["payload"]), r["__pos"]) for r in found.collect())
    assert [r[:3] for r in rows] == want
    assert sorted(r[3] for r in rows) == list(range(len(want)))


def test_a_record_longer_than_many_splits(spark, tmp_path, splits):
    magic = struct.pack("<I", MAGIC)
    long = (b"a" * 37 + magic) * 100
    data = frame(b"first") + frame(long) + frame(b"x", 1) + frame(long, 2) + frame(long + b"y", 3) + frame(b"last")
    (tmp_path / "a.rec").write_bytes(data)
    splits(997)
    pieces = recordio._by_ranges(spark, [str(tmp_path / "a.rec")])
    assert len({s[2] for s in pieces.splits}) >= 2 and len(data) / 997 > 10
    assert [bytes(r["payload"]) for r in read_records(spark, [str(tmp_path / "a.rec")]).orderBy("__pos").collect()] == list(records(data))


def test_a_table_of_splits_beyond_the_broadcast_gives_the_same(spark, tmp_path, splits, monkeypatch):
    data = _random_file(np.random.default_rng(9), 12)
    (tmp_path / "a.rec").write_bytes(data)
    splits(300)
    monkeypatch.setattr(quoted, "BROADCAST_BYTES", 0)
    assert [bytes(r["payload"]) for r in read_records(spark, [str(tmp_path / "a.rec")]).orderBy("__pos").collect()] == list(records(data))


@pytest.mark.parametrize(
    "data,error",
    [
        (frame(b"a", 1) + frame(b"b" * 50), CorruptRecordError), (frame(b"a", 1) + frame(b"b", 2), CorruptRecordError), (frame(b"a", 2), CorruptRecordError),
        (b"xx" + frame(b"a"), CorruptHeaderError), (frame(b"abcdef", 1) + frame(b"b" * 40, 3)[:-8], CorruptHeaderError), (frame(b"a") + b"none", CorruptHeaderError),
        (frame(b"a" * 100) + frame(b"a")[:6], CorruptHeaderError), (frame(b"a" + struct.pack("<I", MAGIC) + b"b" * 11)[:-4], CorruptHeaderError),
    ],
)
def test_damage_is_told_with_the_file(spark, tmp_path, splits, data, error):
    (tmp_path / "bad.rec").write_bytes(data)
    splits(64)
    with pytest.raises(Exception) as told:
        read_records(spark, [str(tmp_path / "bad.rec")]).collect()
    own = translated(told.value) or told.value
    assert type(own) is error and "bad.rec" in str(told.value)


def test_a_header_that_runs_into_the_magic(spark, tmp_path, splits):
    length = 0x030A0000  # with BEGIN: bytes 00 00 0A 23, then D7 CE of the payload
    payload = b"\xd7\xce" + bytes(length - 2)
    assert struct.pack("<I", MAGIC) in frame(payload, 1)[4:]
    (tmp_path / "a.rec").write_bytes(frame(payload, 1) + frame(b"b", 3) + frame(b"c"))
    splits(8 << 20)
    found = [bytes(r["payload"]) for r in read_records(spark, [str(tmp_path / "a.rec")]).orderBy("__pos").collect()]
    assert found == [payload + b"b", b"c"]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-16", "utf-32-be", None])
def test_lines_of_wide_characters_over_many_splits(spark, tmp_path, splits, encoding):
    from rivulet.sources.lines import decode, read_lines, split_lines

    rng = np.random.default_rng(7)
    words = ["red", "ਊ", "Ѐ", "\n", "\r", "\r\n", "ਊЀਊĀ", "😀", "ਊ\n", "", "x" * 30]
    written = encoding or "utf-16"
    datas = ["".join(rng.choice(words, n)).encode(written) for n in (300, 0, 3, 120)] + ["ਊĀ".encode(written) * 200]
    if encoding is None:
        datas += ["plain\nlines\r\nof é".encode(), "".join(rng.choice(words, 80)).encode("utf-32")]
    files = []
    for i, data in enumerate(datas):
        (tmp_path / f"w{i}.txt").write_bytes(data)
        files.append(str(tmp_path / f"w{i}.txt"))
    files.append(files[3])
    want = [(i, n, line) for i, d in enumerate([*datas, datas[3]]) for n, line in enumerate(split_lines(decode(d, encoding)))]
    splits(150)
    rows = sorted((r["__store_idx"], r["__row_idx"], r["value"], r["__pos"]) for r in read_lines(spark, files, encoding=encoding).collect())
    assert [r[:3] for r in rows] == want
    assert sorted(r[3] for r in rows) == list(range(len(want)))


def test_wide_text_that_is_cut_off(spark, tmp_path):
    from rivulet.errors import StreamError
    from rivulet.sources.lines import read_lines

    (tmp_path / "odd.txt").write_bytes("ab\ncd".encode("utf-16-le") + b"x")
    with pytest.raises(Exception) as told:
        read_lines(spark, [str(tmp_path / "odd.txt")], encoding="utf-16-le").collect()
    assert isinstance(translated(told.value) or told.value, StreamError)
