"""Column analysis in one aggregation over all columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.errors import SchemaError
from rivulet.functions.parsing import parse, trim

from .position import POS

MEDIAN_ROWS = 10_000
#: Registers of the cardinality sketches, as a power of two.
SKETCH_BITS = 16


def _statistics(c: Column, text: Column, x: Column, nulls: list[str]) -> dict[str, Column]:
    """c: the cell, text: without white space around it, x: its number, not a number included."""
    length = F.octet_length(c)
    empty, white, rest = c == "", (c != "") & (text == ""), text != ""
    number = x.isNotNull() & ~F.isnan(x)
    x = F.when(number, x)
    words = length - F.octet_length(F.replace(c, F.lit(" "))) + F.when(c.endswith(" "), 0).otherwise(1)
    count = lambda cond: F.count_if(cond).cast("long")
    return {
        "rows_seen": F.count(F.lit(1)),
        "string_empty_count": count(empty),
        "string_min_length": F.coalesce(F.min(F.when(~empty, length)), F.lit(0)).cast("long"),
        "string_min_length_not_empty": F.coalesce(F.min(F.when(~empty, length)), F.lit(0)).cast("long"),
        "string_max_length": F.coalesce(F.max(F.when(~empty, length)), F.lit(0)).cast("long"),
        "string_avg_length": F.coalesce(F.sum(length) / F.count(F.lit(1)), F.lit(0.0)),
        "string_only_whitespace_count": count(white),
        "string_null_like_count": count(rest & F.lower(text).isin([n.lower() for n in nulls])) if nulls else F.lit(0).cast("long"),
        "string_num_words": F.coalesce(F.sum(F.when(~empty, words)), F.lit(0)).cast("long"),
        "numeric_count": count(number),
        "numeric_nan_count": count(rest & ~number),
        "numeric_finite_count": count(number),
        "numeric_int_count": count(number & (F.abs(F.round(x) - x) <= 1e-5)),
        "numeric_finite_mean": F.coalesce(F.avg(x), F.lit(float("nan"))),
        "numeric_finite_min": F.coalesce(F.min(x), F.lit(float("nan"))),
        "numeric_finite_max": F.coalesce(F.max(x), F.lit(float("nan"))),
        "string_cardinality": F.hll_sketch_estimate(F.hll_sketch_agg(F.when(~empty, c), SKETCH_BITS)),
    }


def analyze(df: DataFrame, columns: list[str], null_like_values: list[str] = (), pos: str | None = None) -> DataFrame:
    """One row per column with its statistics: one scan and one aggregation. Null cells count as empty.

    With pos, the rows' position, also example_value (the first cell), string_vocab_cardinality (one more scan) and
    numeric_finite_median_approx (two more), however many columns there are.
    """
    first = [] if pos is None else [F.min_by(F.col(f"c{i}"), "p").alias(f"e{i}") for i in range(len(columns))]
    cells = df.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"c{i}") for i, name in enumerate(columns)), *([F.col(pos).alias("p")] if pos else []))
    texts = cells.select("*", *(trim(F.col(f"c{i}")).alias(f"t{i}") for i in range(len(columns))))
    told = texts.select("*", *(parse(F.col(f"t{i}"), "float64").alias(f"x{i}") for i in range(len(columns))))
    stats = [_statistics(F.col(f"c{i}"), F.col(f"t{i}"), F.col(f"x{i}"), list(null_like_values)) for i in range(len(columns))]
    one = told.agg(*(F.struct(*(s.alias(k) for k, s in own.items())).alias(f"s{i}") for i, own in enumerate(stats)), *first)
    extra = ["r.example_value"] if pos else []
    rows = F.array(*(F.struct(F.lit(name).alias("column"), F.col(f"s{i}").alias("s"), (F.col(f"e{i}") if pos else F.lit(None).cast("string")).alias("example_value")) for i, name in enumerate(columns)))
    out = one.select(F.explode(rows).alias("r")).select("r.column", "r.s.*", *extra)
    if pos is None:
        return out
    return out.join(vocabularies(df, columns), "column").join(medians(df, columns, pos), "column")  # a row a column each


def vocabularies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, string_vocab_cardinality): estimated distinct words, split at single spaces; one scan for all columns."""

    def words(name: str) -> Column:
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cut = F.split(F.when(c.endswith(" "), F.left(c, F.length(c) - 1)).otherwise(c), " ")
        return F.struct(F.lit(name).alias("column"), F.when(c != "", cut).otherwise(F.array().cast("array<string>")).alias("words"))

    held = df.select(F.explode(F.array(*(words(name) for name in columns))).alias("w")).select("w.column", F.explode_outer("w.words").alias("w"))
    return held.groupBy("column").agg(F.hll_sketch_estimate(F.hll_sketch_agg("w", SKETCH_BITS)).alias("string_vocab_cardinality"))


def vocabulary_cardinality(df: DataFrame, column: str) -> DataFrame:
    """Estimated distinct words of one column."""
    return vocabularies(df, [column]).drop("column")


def example_values(df: DataFrame, columns: list[str], pos: str) -> DataFrame:
    return df.agg(*(F.min_by(F.col(c).cast("string"), pos).alias(c) for c in columns))


def medians(df: DataFrame, columns: list[str], pos: str) -> DataFrame:
    """(column, numeric_finite_median_approx): upper medians of the first 10,000 numbers of each column by position.

    Two scans for all columns: the first counts numbers over stretches of positions, each a hundredth longer than the one
    before (some 2000 for 10^12 rows); the second takes those of the stretches in which the first 10,000 lie, so that a task
    beyond them gives nothing.
    """
    spark, each = df.sparkSession, range(len(columns))
    told = df.select(F.col(pos).alias("p"), *(parse(F.col(c).cast("string"), "float64").alias(f"x{i}") for i, c in enumerate(columns)))
    stretch = F.floor(F.log1p(F.col("p") / MEDIAN_ROWS) / log(1.01)).cast("int").alias("stretch")
    told = told.select("p", stretch, *(F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")).alias(f"x{i}") for i in each))
    counts = told.groupBy("stretch").agg(*(F.count(f"x{i}").alias(f"n{i}") for i in each))
    of = counts.select("stretch", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("n")) for i in each)))).where("n > 0")
    before = F.sum("n").over(Window.partitionBy("i").orderBy("stretch")) - F.col("n")
    last = of.withColumn("before", before).where(F.col("before") < MEDIAN_ROWS).groupBy("i").agg(F.max("stretch").alias("last"))
    lasts = last.agg(F.map_from_entries(F.collect_list(F.struct("i", "last"))).alias("m")).scalar()  # one entry a column
    first = lambda i: F.col(f"x{i}").isNotNull() & (F.col("stretch") <= F.try_element_at("lasts", F.lit(i)))
    held = F.array_compact(F.array(*(F.when(first(i), F.struct(F.lit(i).alias("i"), "p", F.col(f"x{i}").alias("x"))) for i in each)))
    numbers = told.withColumn("lasts", lasts).select(F.inline(held))
    ranked = numbers.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("p"))).where(F.col("r") <= MEDIAN_ROWS)
    a = F.col("a")
    upper = ranked.groupBy("i").agg(F.sort_array(F.collect_list("x")).alias("a")).select("i", F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int")).alias("x"))
    names = spark.range(len(columns)).select(F.col("id").cast("int").alias("i"), F.get(F.array(*map(F.lit, columns)), F.col("id").cast("int")).alias("column"))
    return names.join(upper, "i", "left").select("column", F.coalesce("x", F.lit(float("nan"))).alias("numeric_finite_median_approx"))


def median_approx(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Upper median of the first 10,000 numbers by position."""
    return medians(df, [column], pos).drop("column")


def captures(df: DataFrame, columns: list[str], pos: str, most: int = 1000) -> DataFrame:
    """(column, value, n, overflowed): counts of the first `most` distinct values of each column that are neither empty nor
    white space, and whether there were more; one scan for all columns."""
    cells = F.array(*(F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value")) for name in columns))
    seen = df.select(F.col(pos).alias("p"), F.inline(cells)).where(trim(F.col("value")) != "")
    counted = seen.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("first"))).where(F.col("r") <= most + 1)
    told = ranked.withColumn("overflowed", F.max("r").over(Window.partitionBy("column")) > most)  # a bounded number of rows
    return told.where(F.col("r") <= most).select("column", "value", "n", "overflowed")


def capture(df: DataFrame, column: str, pos: str, most: int = 1000) -> DataFrame:
    """captures of one column."""
    return captures(df, [column], pos, most).drop("column")


def concatenate(stores: list[DataFrame]) -> DataFrame:
    """Stores one after the other, with their place as __store_idx."""
    return reduce(DataFrame.unionByName, (s.withColumn("__store_idx", F.lit(i)) for i, s in enumerate(stores)))


@dataclass(frozen=True)
class ColumnAnalysis:
    """What was found about a column; the statistics are attributes."""

    column_name: str
    statistics: dict[str, object]
    string_captured_unique_values: dict[str, int]
    string_captured_unique_values_overflowed: bool

    def __getattr__(self, name: str):
        try:
            return self.__dict__["statistics"][name]
        except KeyError:
            raise AttributeError(name) from None

    def estimate_string_cardinality(self) -> int:
        return self.statistics["string_cardinality"]

    def estimate_string_vocab_cardinality(self) -> int:
        return self.statistics["string_vocab_cardinality"]

    def to_dict(self) -> dict[str, object]:
        """Counts and numbers as text, numbers with six places; cardinalities, captures and the median as they are."""
        plain = ("string_cardinality", "string_vocab_cardinality", "numeric_finite_median_approx", "example_value")
        out = {k: v if k in plain else f"{v:.6f}" if isinstance(v, float) else str(v) for k, v in self.statistics.items()}
        return out | {
            "string_captured_unique_values": self.string_captured_unique_values,
            "string_captured_unique_values_overflowed": self.string_captured_unique_values_overflowed,
        }

    def __repr__(self) -> str:
        return f"ColumnAnalysis({self.column_name})"


@dataclass(frozen=True)
class DataAnalysis:
    columns: list[ColumnAnalysis]


def analyze_dataset(reader, null_like_values: list[str] = (), capture_columns: list[int] = (), max_capture_count: int = 1000) -> DataAnalysis:
    """The whole analysis of a reader's rows, all of whose columns are text; a row a column, and the captured values,
    come to the driver. Columns to capture are given by place. A dataset without rows is an error."""
    names = list(reader.padding())
    kinds = {f.name: f.dataType for f in reader.read_schema()}
    if other := [n for n in names if kinds[n].typeName() != "string"]:
        raise SchemaError(f"not columns of text: {other}")
    df = reader.rows()
    told = {r["column"]: r.asDict() for r in analyze(df, names, null_like_values, POS).collect()}
    if not told or not next(iter(told.values()))["rows_seen"]:
        raise SchemaError("the dataset has no rows")
    wanted = [name for i, name in enumerate(names) if i in capture_columns]
    held: dict[str, list] = {}
    for r in captures(df, wanted, POS, max_capture_count).collect() if wanted else []:
        held.setdefault(r["column"], []).append(r)
    out = []
    for name in names:
        kept = held.get(name, [])
        stats = {k: v for k, v in told[name].items() if k != "column"}
        out.append(ColumnAnalysis(name, stats, {r["value"]: r["n"] for r in kept}, any(r["overflowed"] for r in kept)))
    return DataAnalysis(out)
