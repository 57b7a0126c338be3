"""Queries on rows and sizes that the small tables do not have."""

import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rivulet.plans import formats, ranges
from rivulet.sources import images as images_
from rivulet.sources import lines, recordio, staging, stores


def test_cells_that_equal_the_limit(spark, tmp_path):
    """A 32-bit 0.15 is above 0.15 of 64 bits, and not above that of 32, by which the SQL compares."""
    cells = pa.array([[0.15, 0.1500001, 0.1499999] + [0.0] * 60 + [0.5], [None, float("inf")] * 32], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array([1, 2], pa.int64()), "embedding": cells}), tmp_path / "embeddings.parquet")
    got = formats.sparse_coo_coordinates(spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(formats.ORACLE_SQL["sparse_coo_coordinates"]).select(*columns).fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want) and len(want) == 34


def test_number_of_splits_does_not_grow_with_the_files(spark, tmp_path):
    """Files of small tables have several splits of 16 KB; those of larger ones as many as SPLITS."""
    for n, least, most in ((4_000, 4, 10), (400_000, 60, 70)):
        path = f"{tmp_path}/{n}"
        spark.range(0, n, 1, 3).selectExpr("lpad(id, 19, '0') as value").write.text(path)
        files = stores.list_objects(spark, path, "*.txt")
        held = ranges.small_splits(spark, path).read.text(files)
        assert least <= held.rdd.getNumPartitions() <= most
        assert lines.read_lines(ranges.small_splits(spark, path), files).where("__pos <> cast(value as long)").isEmpty()


def test_plain_images_are_those_of_spark_and_need_no_file(spark, tmp_path):
    """Images of every kind of filter in framed records: as Spark's source decodes files of them; files for few only."""
    rng, images = np.random.default_rng(3), []
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def image(kind, n, filters, extra=b""):
        body = b"".join(bytes([f]) + rng.bytes(9 * n) for f in filters)
        return images_.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, len(filters), 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    for kind, n in ((0, 1), (2, 3), (6, 4)):
        images += [image(kind, n, f) for f in ((0,) * 8, (1, 2, 0, 1, 2, 2, 1, 0), (2, 2, 2, 1, 1, 1, 0, 0))]
    odd = [image(2, 3, (3, 4, 4, 3, 0, 1, 2, 4)), image(4, 2, (0,) * 8), image(0, 1, (0,) * 8, chunk(b"gAMA", struct.pack(">I", 45455))), images[0][:-30]]
    junk = [b"junk", b"\x89PNG"]
    told = [*images, *odd, *junk]
    for i, data in enumerate(told):
        (tmp_path / f"i{i:02}.png").write_bytes(data)
    framed = b"".join(struct.pack("<II", recordio.MAGIC, 24 + len(d)) + bytes(24) + d + bytes(-len(d) % 4) for d in told)
    (tmp_path / "records").write_bytes(framed)
    assert sum(images_.png_rows(d) is not None for d in told) == len(images)
    for n in (1, 3, 4):
        own = lambda how, files: [(r["__pos"], r["value"], r["__bad"]) for r in sorted(images_.read_images(spark, files, images_.ImageParams((n, 5, 6), image_frame=how)).collect(), key=lambda r: r["__pos"])]  # noqa: B023, E731
        before = staging.paths()
        got = own("recordio", [str(tmp_path / "records")])
        written = [p for p in staging.paths() - before if p.endswith("/images")]
        assert len(list(Path(written[0].removeprefix("file:")).glob("*.txt"))) <= len(odd) + 1
        assert got == own("none", [str(tmp_path / f"i{i:02}.png") for i in range(len(told))])


def test_ordered_files_are_written_by_several_tasks(spark):
    """A file a task of the sort, in the order of the rows."""
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        own = spark.range(0, 5_000, 1, 3).orderBy((5_000 - F.col("id"))).select(F.col("id").cast("string").alias("value"))
        files = formats.in_files(own, "ordered")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(files) > 1
    assert lines.read_lines(spark, files).where(F.col("__pos") != 4_999 - F.col("value").cast("long")).isEmpty()
