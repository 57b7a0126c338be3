"""Registered queries of the row operators, readers and column analysis, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.parsing import parse
from rivulet.operators import insights, rows, sparse
from rivulet.operators.position import POS, with_position
from rivulet.params import BadExampleHandling, CsvParams, LastExampleHandling, ReaderParams
from rivulet.readers import CsvReader
from rivulet.schema import Attribute, Schema
from rivulet.sources import csv, lines, protobuf, stores
from rivulet.sources.staging import new_path

from . import formats, ranges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    return with_position(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id")


def orders(spark, sf_dir):
    return with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


def dirty() -> Column:
    """Event values as text, some of which do not parse."""
    k = F.col("event_id") % 97
    text = F.col("user_id").cast("string")
    return F.when(k == 3, F.concat(text, F.lit("f"))).when(k == 7, "inf").when(k == 11, "").when(k == 13, " nan ").when(k == 17, F.concat(F.lit(" "), text, F.lit(" "))).when(k == 19, "   ").when(k == 23, "NA").otherwise(text)


DIRTY_SQL = """CASE event_id % 97 WHEN 3 THEN user_id::VARCHAR || 'f' WHEN 7 THEN 'inf' WHEN 11 THEN '' WHEN 13 THEN ' nan '
  WHEN 17 THEN ' ' || user_id || ' ' WHEN 19 THEN '   ' WHEN 23 THEN 'NA' ELSE user_id::VARCHAR END"""
NUM_SQL = """CASE WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN try_cast(trim({c}) AS DOUBLE) END"""
E_POS = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)"
O_POS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)"


def range_skip_read(spark, sf_dir):
    return rows.skip_read(events(spark, sf_dir), 100, 700).select("event_id", F.col(POS).alias("pos"))


def shard_mod(spark, sf_dir):
    return rows.shard(orders(spark, sf_dir), 4, 1).select("o_orderkey", F.col(POS).alias("pos"))


def sample_prefix_100(spark, sf_dir):
    df = orders(spark, sf_dir)
    return rows.sample(df, 0.25, df.count()).select("o_orderkey", F.col(POS).alias("pos"))


CHAIN = ReaderParams(num_instances_to_skip=100, num_instances_to_read=800, num_shards=3, shard_index=1, sample_ratio=0.25, batch_size=16)


def range_shard_sample_chain(spark, sf_dir):
    return rows.chain(events(spark, sf_dir), CHAIN).select("event_id", F.col(POS).alias("pos"))


def range_shard_sample_batch_pad(spark, sf_dir):
    own = rows.batches(rows.chain(events(spark, sf_dir), CHAIN), {"value": 0.0}, CHAIN.batch_size, LastExampleHandling.PAD)
    return own.select("batch_id", "size", "padding", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _batched(last):
    def query(spark, sf_dir):
        own = rows.batches(events(spark, sf_dir), {"event_id": 0}, 64, last)
        return own.select("batch_id", "size", "padding", F.aggregate("event_id", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))

    return query


def _bad(how):
    def query(spark, sf_dir):
        df = events(spark, sf_dir).withColumn("x", parse(dirty(), "int64", frozenset()))
        own = rows.batches(df, {"x": 0}, 16, LastExampleHandling.PAD if how in (BadExampleHandling.PAD, BadExampleHandling.PAD_WARN) else LastExampleHandling.NONE, F.col("x").isNull(), how)
        return own.select("batch_id", "size", "padding", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

    return query


def bad_rows_report(spark, sf_dir):
    df = events(spark, sf_dir).select(F.col(POS).alias("pos"), dirty().alias("cell"))
    return df.where(parse(F.col("cell"), "int64").isNull())


def concat_stores(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row"), F.col("r_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("name"))
    return insights.concatenate([a, b]).select(F.col("__store_idx").alias("store"), "row", "name")


KINDS = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "float64")


def parse_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", dirty().alias("c"))
    return df.select("event_id", *(parse(F.col("c"), k).cast("double" if k == "float64" else "long").alias(k) for k in KINDS))


def insights_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(dirty().alias("cell"))
    own = insights.analyze(df, ["cell"], ["na", "null"]).drop("string_cardinality")
    return own.withColumns({c: F.round(c, 6) for c in ("string_avg_length", "numeric_finite_mean")})


def insights_text(spark, sf_dir):
    own = insights.analyze(table(spark, sf_dir, "documents"), ["text", "source", "lang"])
    return own.select("column", "rows_seen", "string_empty_count", "string_min_length", "string_max_length", "string_num_words")


def insights_median_10k(spark, sf_dir):
    return insights.median_approx(orders(spark, sf_dir), "o_totalprice", POS)


def insights_capture(spark, sf_dir):
    return insights.capture(orders(spark, sf_dir), "o_orderpriority", POS, 3)


def insights_medians(spark, sf_dir):
    """Of all columns at once, which have numbers in each row, in some or in none."""
    own = with_position(table(spark, sf_dir, "events"), "event_id").withColumn("cell", dirty())
    return insights.medians(own, ["cell", "value", "event_type"], POS)


def insights_captures(spark, sf_dir):
    """The first values of three columns of customers, in the order of their names, a key of text."""
    own = with_position(table(spark, sf_dir, "customer"), "c_name")
    return insights.captures(own, ["c_mktsegment", "c_nationkey", "c_name"], POS, 5)


def sparse_coo_batches(spark, sf_dir):
    """Batches of 16 rows of the same matrices: entries and sums of the coordinates and the data."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    keys = F.filter(F.sequence(F.lit(0).cast("long"), F.size("e").cast("long") - 1), lambda k: F.get("e", k.cast("int")) > 0.15)
    cells = own.select("vec_id", F.struct(keys.alias("keys"), F.transform(keys, lambda k: F.get("e", k.cast("int"))).alias("values")).alias("s"))
    batch = sparse.coo_batches(with_position(cells, "vec_id"), "s", (8, 8), 16)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return batch.select(
        "batch_id", F.size("data").alias("entries"), F.col("shape")[0].alias("rows"), total(F.col("coords")[0]).alias("row_sum"),
        total(F.col("coords")[1]).alias("i_sum"), total(F.col("coords")[2]).alias("j_sum"),
        F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


def csv_table(spark, sf_dir):
    """Customers written as delimited text, read with inferred types, two columns by name."""
    path = new_path(spark, "customers")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    own = csv.read_csv(spark, stores.list_objects(spark, path, "*.csv"), CsvParams(use_columns=frozenset({"c_custkey", "c_name", "c_acctbal"})))
    return own.where("__bad is null").select("c_custkey", "c_name", "c_acctbal")


def csv_projected(spark, sf_dir):
    """Customers as delimited text: three columns by place, two of them by name, keys read as text."""
    path = new_path(spark, "customers")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    params = CsvParams(use_columns=frozenset({"c_custkey", "c_nationkey", "c_acctbal"}), use_columns_by_index=frozenset({0, 1, 2}), column_types={"c_custkey": "string"})
    return csv.read_csv(spark, stores.list_objects(spark, path, "*.csv"), params).where("__bad is null").select("c_custkey", "c_nationkey")


def csv_reader_batches(spark, sf_dir):
    """Customers in order of their key as delimited text, through a reader: skip, shard, padded batches."""
    path = new_path(spark, "customers")
    table(spark, sf_dir, "customer").orderBy("c_custkey").write.option("header", True).csv(path)
    params = ReaderParams(batch_size=16, num_instances_to_skip=10, num_shards=2, shard_index=1, last_example_handling=LastExampleHandling.PAD)
    own = CsvReader(spark, stores.list_objects(spark, path, "*.csv"), params).batches()
    return own.select("batch_id", "size", "padding", F.aggregate("c_custkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


def parse_nan_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", dirty().alias("c"))
    return df.select("event_id", parse(F.col("c"), "float64", frozenset({"NA"})).alias("x"))


def text_lines(spark, sf_dir):
    """Lines of event rows written as text, counted by their length."""
    path = new_path(spark, "events")
    table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_id", "event_type", "props").alias("value")).write.text(path)
    own = lines.read_lines(spark, stores.list_objects(spark, path, "*.txt"))
    return own.groupBy(F.octet_length("value").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))


def protobuf_records(spark, sf_dir):
    """Nation and region keys as 32-bit tensors in messages, through the decoder."""
    key = lambda name: F.unhex(F.concat(F.lit("12053A030A01"), F.lpad(F.hex(name), 2, "0")))
    entry = lambda name, value: F.concat(F.unhex(F.lit("0A0A0A01" + name.encode().hex())), key(value))
    payloads = table(spark, sf_dir, "nation").select("n_name", F.concat(entry("n", F.col("n_nationkey")), entry("r", F.col("n_regionkey"))).alias("payload"))
    own = protobuf.decode_messages(payloads, Schema((Attribute("n", "int32"), Attribute("r", "int32"))))
    return own.where("__bad is null").select("n_name", F.col("n")[0].alias("n"), F.col("r")[0].alias("r"))


QUERIES = {
    "range_skip_read": range_skip_read, "shard_mod": shard_mod, "sample_prefix_100": sample_prefix_100,
    "range_shard_sample_chain": range_shard_sample_chain, "range_shard_sample_batch_pad": range_shard_sample_batch_pad,
    "batch_none": _batched(LastExampleHandling.NONE), "batch_drop": _batched(LastExampleHandling.DROP), "batch_pad": _batched(LastExampleHandling.PAD),
    "bad_skip": _bad(BadExampleHandling.SKIP), "bad_pad": _bad(BadExampleHandling.PAD), "bad_rows_report": bad_rows_report,
    "concat_stores": concat_stores, "parse_numbers": parse_numbers,
    "insights_statistics": insights_statistics, "insights_text": insights_text,
    "insights_median_10k": insights_median_10k, "insights_capture": insights_capture,
    "insights_medians": insights_medians, "insights_captures": insights_captures,
    "sparse_coo_batches": sparse_coo_batches, "csv_table": csv_table, "text_lines": text_lines,
    "csv_projected": csv_projected, "csv_reader_batches": csv_reader_batches, "parse_nan_values": parse_nan_values,
    "protobuf_records": protobuf_records,
    "batch_drop_warn": _batched(LastExampleHandling.DROP_WARN), "batch_pad_warn": _batched(LastExampleHandling.PAD_WARN),
    "bad_skip_warn": _bad(BadExampleHandling.SKIP_WARN), "bad_pad_warn": _bad(BadExampleHandling.PAD_WARN),
} | formats.QUERIES | ranges.QUERIES

_CHAIN_SQL = f"""(SELECT event_id, value, CAST((p2 // 100) * 25 + p2 % 100 AS BIGINT) AS pos FROM (
  SELECT *, (p - 101) // 3 AS p2, (SELECT count(*) FROM {E_POS} WHERE p >= 100 AND p < 900 AND (p - 100) % 3 = 1) AS n
  FROM {E_POS} WHERE p >= 100 AND p < 900 AND (p - 100) % 3 = 1)
  WHERE p2 % 100 < floor(0.25::FLOAT * least(100, n - 100 * (p2 // 100))::FLOAT))"""
_BATCH = f"SELECT CAST(p // 64 AS BIGINT) AS batch_id, {{size}} AS size, {{padding}} AS padding, CAST(sum(event_id) AS BIGINT) AS ids FROM {E_POS} GROUP BY p // 64"
_X = f"(SELECT p, {DIRTY_SQL} AS c FROM {E_POS})"
_INT = "CASE WHEN regexp_full_match(c, '\\s*[+-]?\\d+\\s*') THEN try_cast(trim(c) AS BIGINT) END"
_F = NUM_SQL.format(c="c")

ORACLE_SQL = {
    "range_skip_read": f"SELECT event_id, CAST(p - 100 AS BIGINT) AS pos FROM {E_POS} WHERE p >= 100 AND p < 800",
    "shard_mod": f"SELECT o_orderkey, CAST(p // 4 AS BIGINT) AS pos FROM {O_POS} WHERE p % 4 = 1",
    "sample_prefix_100": f"""SELECT o_orderkey, CAST((p // 100) * 25 + p % 100 AS BIGINT) AS pos FROM {O_POS}
        WHERE p % 100 < floor(0.25::FLOAT * least(100, (SELECT count(*) FROM orders) - 100 * (p // 100))::FLOAT)""",
    "range_shard_sample_chain": f"SELECT event_id, pos FROM {_CHAIN_SQL}",
    "range_shard_sample_batch_pad": f"SELECT CAST(pos // 16 AS BIGINT) AS batch_id, 16 AS size, CAST(16 - count(*) AS INTEGER) AS padding, round(sum(value), 4) AS total FROM {_CHAIN_SQL} GROUP BY pos // 16",
    "batch_none": _BATCH.format(size="CAST(count(*) AS INTEGER)", padding="0"),
    "batch_drop": _BATCH.format(size="64", padding="0") + " HAVING count(*) = 64",
    "batch_pad": _BATCH.format(size="64", padding="CAST(64 - count(*) AS INTEGER)"),
    "bad_skip": f"SELECT CAST(p // 16 AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS size, 0 AS padding, CAST(sum(x) AS BIGINT) AS total FROM (SELECT p, {_INT} AS x FROM {_X}) GROUP BY p // 16 HAVING count(x) = count(*)",
    "bad_pad": f"SELECT CAST(p // 16 AS BIGINT) AS batch_id, 16 AS size, CAST(16 - count(x) AS INTEGER) AS padding, CAST(coalesce(sum(x), 0) AS BIGINT) AS total FROM (SELECT p, {_INT} AS x FROM {_X}) GROUP BY p // 16",
    "bad_rows_report": f"SELECT CAST(p AS BIGINT) AS pos, c AS cell FROM {_X} WHERE ({_INT}) IS NULL",
    "concat_stores": "SELECT 0 AS store, r_regionkey AS row, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation",
    "parse_numbers": f"SELECT event_id, {', '.join(f'CASE WHEN x BETWEEN {a} AND {b} THEN x END AS {k}' for k, a, b in (('int8', -128, 127), ('uint8', 0, 255), ('int16', -32768, 32767), ('uint16', 0, 65535), ('int32', -2147483648, 2147483647), ('uint32', 0, 4294967295)))}, x AS int64, CASE WHEN trim(c) = 'nan' THEN 'nan'::DOUBLE ELSE f END AS float64 FROM (SELECT event_id, c, {_INT} AS x, {_F} AS f FROM (SELECT event_id, {DIRTY_SQL} AS c FROM events))",
    "insights_statistics": f"""SELECT 'cell' AS "column", count(*) AS rows_seen, count(*) FILTER (c = '') AS string_empty_count,
        min(strlen(c)) FILTER (c <> '') AS string_min_length, min(strlen(c)) FILTER (c <> '') AS string_min_length_not_empty, max(strlen(c)) AS string_max_length, round(CAST(sum(strlen(c)) AS DOUBLE) / count(*), 6) AS string_avg_length,
        count(*) FILTER (c <> '' AND trim(c) = '') AS string_only_whitespace_count, count(*) FILTER (lower(trim(c)) IN ('na', 'null')) AS string_null_like_count,
        CAST(sum(CASE WHEN c <> '' THEN len(string_split(c, ' ')) - CASE WHEN c LIKE '% ' THEN 1 ELSE 0 END END) AS BIGINT) AS string_num_words,
        count(f) AS numeric_count, count(*) FILTER (trim(c) <> '' AND f IS NULL) AS numeric_nan_count, count(f) AS numeric_finite_count,
        count(*) FILTER (abs(round(f) - f) <= 1e-5) AS numeric_int_count, round(avg(f), 6) AS numeric_finite_mean, min(f) AS numeric_finite_min, max(f) AS numeric_finite_max
        FROM (SELECT c, {_F} AS f FROM {_X})""",
    "insights_text": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows_seen, count(*) FILTER (coalesce({c}, '') = '') AS string_empty_count, coalesce(min(strlen({c})) FILTER ({c} <> ''), 0) AS string_min_length,
        coalesce(max(strlen({c})), 0) AS string_max_length, CAST(coalesce(sum(CASE WHEN {c} <> '' THEN len(string_split({c}, ' ')) - CASE WHEN {c} LIKE '% ' THEN 1 ELSE 0 END END), 0) AS BIGINT) AS string_num_words FROM documents"""
        for c in ("text", "source", "lang")
    ),
    "insights_median_10k": f"SELECT list_sort(list(x))[len(list(x)) // 2 + 1] AS numeric_finite_median_approx FROM (SELECT o_totalprice AS x FROM {O_POS} WHERE p < 10000)",
    "insights_capture": f"SELECT value, n, more > 3 AS overflowed FROM (SELECT o_orderpriority AS value, count(*) AS n, min(p) AS f, count(*) OVER () AS more FROM {O_POS} GROUP BY 1) ORDER BY f LIMIT 3",
    "insights_medians": f"""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, {DIRTY_SQL} AS cell, value::DOUBLE AS value FROM events),
        x AS (SELECT 'cell' AS "column", p, try_cast(trim(cell) AS DOUBLE) AS x FROM e WHERE regexp_matches(trim(cell), '^[0-9]+$') UNION ALL SELECT 'value', p, value FROM e WHERE value IS NOT NULL),
        f AS (SELECT "column", list_sort(list(x)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY p) AS r FROM x) WHERE r <= 10000 GROUP BY 1)
        SELECT "column", a[len(a) // 2 + 1] AS numeric_finite_median_approx FROM f UNION ALL SELECT 'event_type', 'nan'::DOUBLE""",
    "insights_captures": """WITH c AS (SELECT unnest(['c_mktsegment', 'c_nationkey', 'c_name']) AS "column", unnest([c_mktsegment::VARCHAR, c_nationkey::VARCHAR, c_name::VARCHAR]) AS value,
          row_number() OVER (ORDER BY c_name) AS p FROM customer),
        v AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY min(p)) AS r, count(*) OVER (PARTITION BY "column") AS m FROM c WHERE trim(value) <> '' GROUP BY 1, 2)
        SELECT "column", value, n, m > 5 AS overflowed FROM v WHERE r <= 5""",
    "sparse_coo_batches": """SELECT CAST(p // 16 AS BIGINT) AS batch_id, CAST(count(k) AS INTEGER) AS entries, max(n) AS rows, CAST(coalesce(sum(p % 16) FILTER (k IS NOT NULL), 0) AS BIGINT) AS row_sum,
        CAST(coalesce(sum((k // 8) % 8), 0) AS BIGINT) AS i_sum, CAST(coalesce(sum(k % 8), 0) AS BIGINT) AS j_sum, round(coalesce(sum(x), 0), 4) AS total
        FROM (SELECT p, n, k, x FROM (SELECT *, count(*) OVER (PARTITION BY p // 16) AS n FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings))
        LEFT JOIN (SELECT vec_id AS v, k - 1 AS k, CAST(embedding[k] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) WHERE CAST(embedding[k] AS DOUBLE) > 0.15) ON v = vec_id)
        GROUP BY p // 16""",
    "csv_table": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "csv_projected": "SELECT c_custkey::VARCHAR AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer",
    "csv_reader_batches": """SELECT CAST(p // 32 AS BIGINT) AS batch_id, 16 AS size, CAST(16 - count(*) AS INTEGER) AS padding, CAST(sum(c_custkey) AS BIGINT) AS keys
        FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 11 AS p FROM customer) WHERE p >= 0 AND p % 2 = 1 GROUP BY p // 32""",
    "parse_nan_values": f"SELECT event_id, CASE WHEN trim(c) IN ('nan', 'NA') THEN 'nan'::DOUBLE ELSE {_F} END AS x FROM (SELECT event_id, {DIRTY_SQL} AS c FROM events)",
    "text_lines": "SELECT CAST(strlen(event_id || ' ' || event_type || ' ' || props) AS INTEGER) AS bytes, count(*) AS n FROM events GROUP BY 1",
    "protobuf_records": "SELECT n_name, n_nationkey AS n, n_regionkey AS r FROM nation",
} | formats.ORACLE_SQL | ranges.ORACLE_SQL
ORACLE_SQL |= {f"{name}_warn": ORACLE_SQL[name] for name in ("batch_drop", "batch_pad", "bad_skip", "bad_pad")}
