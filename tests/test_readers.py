"""Readers on files written here: dialect, headers, names, types, positions, framing."""

import gzip
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.errors import CorruptFooterError, CorruptHeaderError, CorruptRecordError, SchemaError, StreamError
from rivulet.functions.parsing import infer_data_type
from rivulet.operators import rows
from rivulet.operators.position import POS, with_position
from rivulet.params import CsvParams, LastExampleHandling, MaxFieldLengthHandling, ReaderParams
from rivulet.sources import csv, lines, parquet_stream, recordio, stores
from rivulet.streaming import examples


def write(folder, **files):
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return stores.list_files(str(folder))


def test_natural_order(tmp_path):
    paths = write(tmp_path, f10__csv="", f2__csv="", f1__txt="")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["f1.txt", "f2.csv", "f10.csv"]
    assert len(stores.list_files(str(tmp_path), "*.csv")) == 2
    assert len(stores.list_files(str(tmp_path), predicate=lambda p: "f2" in p)) == 1


def test_lines_in_order(spark, tmp_path):
    paths = write(tmp_path, f10__txt="e\r\nf", f2__txt="﻿a\nb\n\n", f9__txt__gz=gzip.compress(b"c\n") + gzip.compress(b"d\n"))
    rows = lines.read_lines(spark, paths).orderBy("__pos").collect()
    assert [(r["value"], r["__pos"], r["__store_idx"], r["__row_idx"]) for r in rows] == [
        ("a", 0, 0, 0), ("b", 1, 0, 1), ("", 2, 0, 2), ("c", 3, 1, 0), ("d", 4, 1, 1), ("e", 5, 2, 0), ("f", 6, 2, 1)]


def test_lines_over_splits(spark, tmp_path):
    paths = write(tmp_path, a__txt="".join(f"{i}\n" for i in range(4000)), b__txt="".join(f"{i}\n" for i in range(4000, 6000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        bad = lines.read_lines(spark, paths).where("cast(value as long) <> __pos").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == 0


def test_positions_outlive_the_split_plan(spark, tmp_path):
    """Splits are dealt otherwise when the rows are read than when they were counted."""
    paths = write(tmp_path, **{f"f{k}__txt": "".join(f"{i}\n" for i in range(k * 100, k * 100 + 100)) for k in range(15)})
    own = lines.read_lines(spark, paths)
    held = csv.read_csv(spark, paths, CsvParams(header_row_index=None, column_names=("n",)))
    changed = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "200"}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        for df, name in ((own, "value"), (held, "n")):
            assert df.count() == 1500 and df.where(F.col(name).cast("long") != F.col("__pos")).count() == 0
    finally:
        for key in changed:
            spark.conf.unset(key)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 2, 3), (0, 2, 1, 3), (1, 1, 0, 2, 3, 0), (3, 0, 2, 1), (1, 3)])
@pytest.mark.parametrize("single", [False, True])
def test_empty_short_and_repeated_files(spark, tmp_path, order, single):
    texts = ["k,v\n1,a\n2,b\n", "", "k,v\n3,c", "k,v\n"]
    paths = write(tmp_path, **{f"f{i}__csv": t for i, t in enumerate(texts)})
    own = csv.read_csv(spark, [paths[i] for i in order], CsvParams(has_single_header=single, default_data_type="string"))
    assert own.columns[:2] == ["k", "v"]
    want, met = [], False
    for place, i in enumerate(order):
        rows = texts[i].split()
        rows = rows[0 if single and met else 1 :]
        met |= bool(texts[i])
        want += [(place, *r.split(",")) for r in rows]
    got = own.orderBy("__pos").collect()
    assert [(r["__store_idx"], r["k"], r["v"]) for r in got] == want and [r["__pos"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (["foo", "bar", "bar", "bar", "foo"], ["foo", "bar", "bar_1", "bar_2", "foo_1"]),
        (["foo", "foo", "foo_1", "foo_1", "bar"], ["foo", "foo_1", "foo_1_1", "foo_1_2", "bar"]),
        (["a", "b"], ["a", "b"]),
    ],
)
def test_dedupe(names, want):
    assert csv.dedupe(names) == want


def test_tokenizer():
    assert csv.tokenize('"a""b",x"y,"q"z,') == ['a"b', 'x"y', "qz", ""]
    assert csv.tokenize("") == [""]
    with pytest.raises(CorruptRecordError):
        csv.tokenize('a,"b')


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_characters="\n\r"), max_size=8), min_size=1, max_size=5))
def test_tokenizer_round_trip(fields):
    assert csv.tokenize(",".join('"' + f.replace('"', '""') + '"' for f in fields)) == fields


def test_csv(spark, tmp_path):
    paths = write(tmp_path, a__csv="n,x,s\n#no\n1,1.5,p\n\n2,1f,q\n3,2\n", b__csv='n,x,s\n4,nan,"r,r"\n')
    rows = csv.read_csv(spark, paths, CsvParams(comment_char="#")).orderBy("__pos").collect()
    assert [(r["n"], r["s"], r["__pos"], r["__bad"]) for r in rows] == [
        (1, "p", 0, None), (2, "q", 1, "x is not float64: '1f'"), (None, None, 2, "2 fields instead of 3"), (4, "r,r", 3, None)]
    one = csv.read_csv(spark, paths[:1], CsvParams(comment_char="#", use_columns=frozenset({"s"})))
    assert one.columns[0] == "s"
    plain = csv.read_csv(spark, paths[:1], CsvParams(header_row_index=None, comment_char="#", default_data_type="string"))
    assert plain.columns[:3] == ["1", "2", "3"] and plain.where("__bad is null").count() == 3
    single = csv.read_csv(spark, paths, CsvParams(comment_char="#", has_single_header=True, default_data_type="string"))
    assert single.where("n = 'n'").count() == 1


def test_csv_fields_and_names(spark, tmp_path):
    paths = write(tmp_path, a__csv="a,a\nabcdef,1\n")
    with pytest.raises(SchemaError):
        csv.read_csv(spark, paths, CsvParams(dedupe_column_names=False))
    bad = csv.read_csv(spark, paths, CsvParams(max_field_length=3)).first()
    assert bad["__bad"] == "a field is too long"
    cut = csv.read_csv(spark, paths, CsvParams(max_field_length=3, max_field_length_handling=MaxFieldLengthHandling.TRUNCATE)).first()
    assert (cut["a"], cut["a_1"]) == ("abc", 1)
    with pytest.raises(ValueError, match="unknown columns"):
        csv.read_csv(spark, paths, CsvParams(column_types={"z": "int8"}))


def test_inference():
    kinds = {"": "string", "7": "int64", str(2**63): "uint64", "1e3": "float64", "inf": "string", "1e400": "string", "nan": "float64", "x": "string", str(2**64): "float64"}
    assert {k: infer_data_type(k) for k in kinds} == kinds


def frame(kind, payload):
    return struct.pack("<II", recordio.MAGIC, kind << 29 | len(payload)) + payload + b"\0" * (-len(payload) % 4)


def test_records(spark, tmp_path):
    data = frame(0, b"one") + frame(1, b"t") + frame(2, b"w") + frame(3, b"o") + frame(0, b"")
    paths = write(tmp_path, a__rec=data)
    rows = recordio.read_records(spark, paths).orderBy("__row_idx").collect()
    assert [bytes(r["payload"]) for r in rows] == [b"one", b"two", b""]
    with pytest.raises(CorruptRecordError, match="record #1"):
        list(recordio.records(frame(0, b"x") + frame(2, b"y")))
    with pytest.raises(CorruptHeaderError):
        list(recordio.frames(data[:9]))


def test_records_cut_where_files_are_split(spark, tmp_path):
    import random

    draw = random.Random(3)
    payloads = [draw.randbytes(draw.randrange(0, 90)) for _ in range(700)]
    plain = b"".join(frame(0, p) for p in payloads)
    tricky = frame(0, b"ab" + struct.pack("<I", recordio.MAGIC) + b"cd") + frame(0, b"z")
    split = frame(1, b"x") + frame(3, b"y") + frame(0, b"")
    a, b, c, d = write(tmp_path, a__rec=plain, b__rec=b"", c__rec=tricky, d__rec=split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        for files, want in (([a, b, a], payloads * 2), ([a, c], [*payloads, b"ab" + struct.pack("<I", recordio.MAGIC) + b"cd", b"z"]), ([d, a], [b"xy", b"", *payloads])):
            assert len({s[2] for s in recordio._by_ranges(spark, files).splits if s[1].endswith("a.rec")}) > 3  # whatever stands beside it
            got = recordio.read_records(spark, files).orderBy("__pos").collect()
            assert [bytes(r["payload"]) for r in got] == want and [r["__pos"] for r in got] == list(range(len(want)))
            assert {r["__store_idx"] for r in got} == ({0, 2} if len(files) == 3 else {0, 1})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bad = write(tmp_path, e__rec=frame(0, b"whole") + frame(0, b"cut off")[:-3])[-1]
    with pytest.raises(Exception, match="is cut off"):
        recordio.read_records(spark, [bad]).collect()


def test_parquet_stream(spark, tmp_path):
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    def file(n):
        out = io.BytesIO()
        pq.write_table(pa.table({"a": list(range(n)), "s": ["PAR1"] * n}), out)
        return out.getvalue()

    paths = write(tmp_path, a__bin=file(3) + file(500))
    rows = parquet_stream.read_parquet_stream(spark, paths).orderBy("__row_idx").collect()
    assert [pq.read_table(io.BytesIO(bytes(r["payload"]))).num_rows for r in rows] == [3, 500]
    with pytest.raises(CorruptFooterError):
        list(parquet_stream.split(file(3)[:-2]))
    with pytest.raises(CorruptHeaderError):
        list(parquet_stream.split(b"x"))


def test_parquet_streams_over_splits(spark, tmp_path):
    """Streams cut at any byte give the files that a walk from the beginning gives; one whose data hold both marks is
    walked, as the damaged ones are."""
    import gzip
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    def file(n, text="PAR1"):
        out = io.BytesIO()
        pq.write_table(pa.table({"a": list(range(n)), "s": [f"{text}{i}" for i in range(n)]}), out, use_dictionary=False, compression="none")
        return out.getvalue()

    plain = b"".join(file(n) for n in (3, 0, 40, 1, 7, 90))
    marks = file(5) + file(30, "xPAR1PAR1") + file(2)
    assert list(parquet_stream.split(marks)) == [file(5), file(30, "xPAR1PAR1"), file(2)]
    paths = write(tmp_path, a__bin=plain, b__bin=marks, c__bin=b"", d__bin=file(4), e__gz=gzip.compress(plain))
    want = [*parquet_stream.split(plain), *parquet_stream.split(marks), file(4), *parquet_stream.split(plain), *parquet_stream.split(plain)]
    seam = len(file(3))
    for size in (1 << 20, 1000, *range(seam - 6, seam + 6)):
        own = spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = parquet_stream.read_parquet_stream(own, [*paths, paths[0]]).orderBy(POS).collect()
        assert [bytes(r["payload"]) for r in rows] == want, size
        assert [r[POS] for r in rows] == list(range(len(want)))
        assert [r["__row_idx"] for r in rows if r["__store_idx"] == 5] == list(range(6))
    assert parquet_stream.read_parquet_stream(spark, [paths[2]]).count() == 0
    cut, junk = write(tmp_path, g__bin=plain[:-2], h__bin=b"junk" + plain)[-2:]
    for path, said in ((cut, "does not end"), (junk, "no Parquet file begins")):
        with pytest.raises(Exception, match=said):
            parquet_stream.read_parquet_stream(spark, [paths[0], path]).collect()


def test_examples(spark):
    df = with_position(spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("x")), "k")
    own = examples.Examples(lambda epoch: rows.batches(df, {"k": 0, "x": 0.0}, 4, LastExampleHandling.PAD))
    for _ in range(2):
        assert own.peek()["batch_id"] == 0
        got = list(own)
        assert [e["k"] for e in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 0]] and got[2]["padding"] == 2
        assert examples.as_numpy(got[0], "x").tolist() == [0, 2, 4, 6] and len(examples.to_pandas(got[1])) == 4
        own.reset()


def test_row_operators_in_sequence(spark):
    """The closed forms against the operators applied one after the other to a list."""
    df = with_position(spark.range(1234).toDF("k"), "k").cache()
    for skip, read, shards, index, ratio in ((0, None, 1, 0, 0.5), (7, 1000, 3, 2, 0.29), (100, 150, 2, 1, 0.9), (0, 90, 1, 0, 0.005), (3, 0, 1, 0, 0.5)):
        want = list(range(1234))[skip : None if read is None else skip + read][index::shards]
        out = []
        for at in range(0, len(want), 100):
            block = want[at : at + 100]
            n = rows.sampled(ratio, len(block))
            out += block[:n]
            if n == 0:
                break
        p = ReaderParams(num_instances_to_skip=skip, num_instances_to_read=read, num_shards=shards, shard_index=index, sample_ratio=ratio)
        for total in (None, 1234):
            got = rows.chain(df, p, total).orderBy("__pos").collect()
            assert [r["k"] for r in got] == out and [r["__pos"] for r in got] == list(range(len(out)))


def test_encodings(spark, tmp_path):
    paths = write(tmp_path, a__csv="n,s\r\n1,привет\r\n2,мир\r\n".encode("iso8859_5"))
    got = csv.read_csv(spark, paths, CsvParams(encoding="ISO-8859-5")).orderBy("__pos").collect()
    assert [(r["n"], r["s"], r["__pos"]) for r in got] == [(1, "привет", 0), (2, "мир", 1)]


def test_encodings_are_split(spark, tmp_path):
    text = "".join(f"{i} привет\n" for i in range(900))
    a, b = write(tmp_path, a__txt=text.encode("iso8859_5"), b__txt=text.encode("utf-16"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for path, encoding in ((a, "ISO-8859-5"), (b, "UTF-16")):
            own = lines.number_lines(spark, [path], encoding=encoding)
            assert len(own.splits) >= 4
            got = own.lines().orderBy("__pos").collect()
            assert [r["value"] for r in got] == text.splitlines()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not any(map(lines.line_ends_are_plain, ("utf-16-le", "UTF-32", "utf-7", "iso2022_jp", "cp037", "hz")))
    assert all(map(lines.line_ends_are_plain, ("8859_1", "cp1252", "gbk", "shift_jis", "ascii")))
    with pytest.raises(StreamError):
        lines.read_lines(spark, [a], encoding="no such")


def test_quoted_records_over_splits(spark, tmp_path):
    """Cut split by split as the whole text is: records over many splits, comments, lone quotes, all line ends."""
    import random

    from rivulet.sources import quoted

    draw = random.Random(11)
    texts = []
    for _ in range(6):
        parts = []
        for _ in range(draw.randrange(1, 60)):
            fields = [draw.choice(["a", "", 'x"y', '"q"', '"l1\nl2"', '"l1\r\n\r""z"', '"' + "long\n" * draw.randrange(30) + '"', "#", "é"]) for _ in range(draw.randrange(1, 4))]
            parts.append(draw.choice(["", "", "#c "]) + ",".join(fields) + draw.choice(["\n", "\n", "\r\n", "\r"]))
        texts.append("".join(parts).rstrip("\r\n") if draw.random() < 0.5 else "".join(parts))
    texts[2] = ""
    paths = write(tmp_path, **{f"f{i}__csv": t for i, t in enumerate(texts)})
    for comment in (None, "#"):
        cut = quoted.quoted_records(quoted.Dialect(comment=comment))
        want = [(i, r) for i, t in enumerate(texts) for r in cut(t)]
        for size in ("37", "200", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                own = lines.number_lines(spark, paths, records=cut)
                got = own.lines().orderBy("__pos").collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert [(r["__store_idx"], r["value"]) for r in got] == want
            assert [r["__pos"] for r in got] == list(range(len(want)))
            assert (len(own.splits) > 5) == (size != "1m")
    rows = csv.read_csv(spark, write(tmp_path, u__csv='k,v\n1,"a\nb"\n'.encode("utf-16"))[-1:], CsvParams(allow_quoted_new_lines=True)).collect()
    assert [(r["k"], r["v"]) for r in rows] == [(1, "a\nb")]


def test_quoted_lines_take_one_python_process_a_task(spark, tmp_path):
    """Records are cut and tokenized where they are, over splits too, and tables of splits come without Python: as many
    processes as tasks, whatever is asked of the rows."""
    text = "".join(f'{i},"a\n{"x" * (i % 40)}\r\n""z"\n' + ("" if i % 7 else f'{i},"lone\n"y,more\n\n') + ("" if i % 11 else f"{i},plain\n") for i in range(60)) + '9,"open\n'
    paths = write(tmp_path, a__csv=text, b__csv='7,"b\n"')
    p = CsvParams(header_row_index=None, column_names=("k", "s"), allow_quoted_new_lines=True)
    want = []
    for own in (text, '7,"b\n"'):
        for record in filter(None, csv.quoted_records()(own)):
            try:
                cells = csv.tokenize(record)
                want.append((int(cells[0]), cells[1], None) if len(cells) == 2 else (None, None, f"{len(cells)} fields instead of 2"))
            except CorruptRecordError as e:
                want.append((None, None, str(e)))
    for size in ("90", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = csv.read_csv(spark, paths, p)
            assert [(r["k"], r["s"], r["__bad"]) for r in read.orderBy("__pos").collect()] == want
            plan = read.where("__bad is null").select("k", "s")._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert plan.count("MapInPandas") == 1 and "pythonUDF" not in plan and "ArrowEvalPython" not in plan and "LogicalRDD" not in plan
    short = CsvParams(header_row_index=None, column_names=("k", "s"), allow_quoted_new_lines=True, max_field_length=9)
    assert [(r["k"], r["s"]) for r in csv.read_csv(spark, paths, short).orderBy("__pos").collect()] == [(k, s) if s is not None and len(s) <= 9 else (None, None) for k, s, _ in want]
