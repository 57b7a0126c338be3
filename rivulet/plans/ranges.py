"""Registered queries over files that several tasks wrote and that are read in many splits each, held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.position import POS
from rivulet.sources import lines, recordio, stores
from rivulet.sources.staging import new_path

#: Least bytes of a split, so that files of the small tables have several, and splits of larger files, whose number does
#: not grow with them until a split has the bytes that the session sets.
SPLIT, SPLITS = 16 << 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(own).getLength()


def split_bytes(total: int, most: int) -> int:
    """Bytes of a split of files of so many bytes."""
    return min(most, max(SPLIT, -(-total // SPLITS)))


def small_splits(spark: SparkSession, path: str) -> SparkSession:
    """A session that reads the files below a path in several splits."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes(bytes_of(spark, path), most)))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


def in_order(df: DataFrame, key: str, tasks: int = 4) -> DataFrame:
    """Rows in the order of a unique key over the files that they will be written to, a file a task."""
    return df.repartitionByRange(tasks, key).sortWithinPartitions(key)


def frame(kind: int, payload: Column) -> Column:
    """A framed record, its padding included."""
    word = F.lit(kind << 29).bitwiseOR(F.octet_length(payload))
    low_first = (F.unhex(F.lpad(F.hex(F.shiftright(word, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4))
    padding = F.substring(F.lit(bytes(3)), F.lit(1), F.pmod(-F.octet_length(payload), F.lit(4)))
    return F.concat(F.lit(recordio.SEPARATOR), *low_first, payload, padding)


def records_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as framed records: every third is split into three, its middle the magic; of every fifth other one, the
    payload holds the magic. Payloads end with a zero byte, which the text writer sets as its line end."""
    magic, zero = F.lit(recordio.SEPARATOR), F.lit(b"\0")
    said = F.concat_ws("|", "o_orderkey", "o_orderpriority", "o_custkey").cast("binary")
    begin, rest = F.substring(said, 1, 5), F.concat(F.expr("substring(said, 6)"), zero)
    framed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(frame(recordio.BEGIN, begin), frame(recordio.MIDDLE, magic), frame(recordio.END, rest)))
    framed = framed.when(F.col("o_orderkey") % 5 == 0, frame(recordio.COMPLETE, F.concat(begin, magic, rest)))
    framed = framed.otherwise(frame(recordio.COMPLETE, F.concat(F.col("said"), zero)))
    rows = in_order(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("said", said).select(framed.alias("data"))
    path = new_path(spark, "records")
    rows.select(F.expr("substring(data, 1, octet_length(data) - 1)").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    own = recordio.read_records(small_splits(spark, path), stores.list_objects(spark, path, "*.txt"))
    return own.select(F.col(POS).alias("pos"), F.col("__store_idx").isNotNull().alias("stored"), F.hex("payload").alias("payload"))


def text_of_wide_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of UTF-16 (by name and by mark) and UTF-32, each file in many splits; every seventh line holds
    characters whose bytes look like a line end across two characters."""
    said = F.concat_ws("|", "event_id", "event_type", F.when(F.col("event_id") % 7 == 0, "ਊਅa਀")).alias("value")
    rows = in_order(table(spark, sf_dir, "events"), "event_id", 3).select(said)
    parts = []
    for written, read in (("UTF-16LE", "utf-16-le"), ("UTF-16BE", "utf-16-be"), ("UTF-16", None), ("UTF-32", "utf-32-be")):
        path = new_path(spark, "wide")
        rows.write.option("encoding", written).option("quote", "").option("escape", "").option("sep", "\1").csv(path)
        files = stores.list_objects(spark, path, "*.csv")
        parts.append(lines.read_lines(small_splits(spark, path), files, encoding=read).select(F.lit(written).alias("encoding"), F.col(POS).alias("pos"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {"records_over_splits": records_over_splits, "text_of_wide_characters": text_of_wide_characters}

ORACLE_SQL = {
    "records_over_splits": """
        WITH o AS (
          SELECT o_orderkey AS k, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey || '|' || o_orderpriority || '|' || o_custkey AS said FROM orders)
        SELECT pos, true AS stored, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN hex(left(said, 5)) || '0A23D7CE' || hex(said[6:]) ELSE hex(said) END || '00' AS payload FROM o""",
    "text_of_wide_characters": """
        SELECT encoding, CAST(row_number() OVER (PARTITION BY encoding ORDER BY event_id) - 1 AS BIGINT) AS pos,
               concat_ws('|', event_id, event_type, CASE WHEN event_id % 7 = 0 THEN chr(2570) || chr(2565) || 'a' || chr(2560) END) AS value
        FROM events, (VALUES ('UTF-16LE'), ('UTF-16BE'), ('UTF-16'), ('UTF-32')) t(encoding)""",
}
