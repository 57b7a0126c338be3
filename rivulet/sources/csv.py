"""Delimited text in the readers' own dialect.

Lines are read and numbered by Spark; names and types come from the first lines on the driver. Spark cuts the lines that
hold no quote; the tokenizer runs over Arrow batches of the others. The typed values are Spark expressions over the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import CorruptRecordError, SchemaError
from rivulet.functions.parsing import SPARK_TYPES, infer_data_type, parse
from rivulet.params import CsvParams, MaxFieldLengthHandling

from .lines import Numbered, number_lines
from .quoted import Dialect, quoted_records


def tokenize(line: str, delimiter: str = ",", quote: str = '"') -> list[str]:
    """Fields of a record. A quote opens a field only at its start; two stand for one inside; what follows a closing
    quote is taken as it is."""
    fields, at, n = [], 0, len(line)
    while True:
        own = []
        if quote and at < n and line[at] == quote:
            at += 1
            while True:
                end = line.find(quote, at)
                if end < 0:
                    raise CorruptRecordError("the quoted field is not closed")
                own.append(line[at:end])
                at = end + 1
                if at < n and line[at] == quote:
                    own.append(quote)
                    at += 1
                else:
                    break
        end = line.find(delimiter, at)
        own.append(line[at:] if end < 0 else line[at:end])
        fields.append("".join(own))
        if end < 0:
            return fields
        at = end + 1


def dedupe(names: list[str]) -> list[str]:
    """A name met before gets the number of times it was met, again and again until it is new."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        while name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name] - 1}"
        seen[name] = 1
        out.append(name)
    return out


def column_types(names: list[str], row: list[str] | None, p: CsvParams) -> list[str]:
    kinds = [p.default_data_type or ("string" if row is None else infer_data_type(c)) for c in (row or names)]
    if over := sorted(i for i in p.column_types_by_index if not 0 <= i < len(kinds)):
        raise ValueError(f"column indices out of range: {over}")
    for i, kind in p.column_types_by_index.items():
        kinds[i] = kind
    if missing := sorted(set(p.column_types) - set(names)):
        raise ValueError(f"unknown columns: {missing}")
    for name, kind in p.column_types.items():
        kinds[names.index(name)] = kind
    return kinds


def _lines_at(spark: SparkSession, stores: list, numbered: Numbered, read: Callable[[list], Numbered], store: int, at: int, n: int) -> list[str]:
    """n lines of a store from place `at` on: only that store is read again."""
    own = numbered if len(stores) == 1 else read([stores[store]])
    got = own.lines().where(F.col("__row_idx").between(at, at + n - 1)).select("__row_idx", "value").take(n)
    return [r["value"] for r in sorted(got)]


def read_csv(spark: SparkSession, stores: list, params: CsvParams | None = None) -> DataFrame:
    """The kept columns, with __store_idx, __row_idx, __pos, __bytes (of the line), __note (null, or what was done to the
    row) and __bad (null, or why the row does not decode).

    Each store has a header, or the first one with lines if has_single_header; a store that ends before its header row
    gives no rows. Names come from the first header there is. Lines without a quote are cut in the JVM.
    """
    p = params or CsvParams()
    keep = F.lit(True)
    if p.comment_char:
        keep &= ~F.col("value").startswith(p.comment_char)
    if p.skip_blank_lines:
        keep &= F.col("value") != ""
    records = quoted_records(Dialect(p.delimiter, p.quote_char, p.comment_char), tokenize if p.max_field_length is None else None) if p.allow_quoted_new_lines else None
    read = lambda own: number_lines(spark, own, keep, p.encoding, p.compression, records)
    numbered = read(stores) if stores else None
    counts = numbered.counts() if stores else {}
    head = 0 if p.header_row_index is None else p.header_row_index + 1
    header = row = None
    first = next(iter(counts), None)
    titled = next((s for s, n in counts.items() if n >= head), None) if head else None
    if head and p.has_single_header and titled != first:
        titled = None
    filled = next((s for s, n in counts.items() if n > (head if not p.has_single_header or s == first else 0)), None)
    if titled is not None:
        got = _lines_at(spark, stores, numbered, read, titled, head - 1, 2)
        header = tokenize(got[0], p.delimiter, p.quote_char)
        if titled == filled:
            row = tokenize(got[1], p.delimiter, p.quote_char)
    if row is None and filled is not None:
        at = head if not p.has_single_header or filled == first else 0
        row = tokenize(_lines_at(spark, stores, numbered, read, filled, at, 1)[0], p.delimiter, p.quote_char)
    if p.column_names:
        names = list(p.column_names)
    elif header is not None:
        names = [p.name_prefix + h for h in header] if header != [""] else [p.name_prefix]
    elif row is not None:
        names = [f"{p.name_prefix}{i + 1}" for i in range(len(row))]
    else:
        raise SchemaError("there is nothing to take the columns from")
    if row is not None and len(row) != len(names):
        raise SchemaError(f"the first row has {len(row)} columns, the header {len(names)}")
    kinds = column_types(names, row, p)
    kept, final = _kept(names, p)

    if numbered is not None:
        data = numbered.lines(head, p.has_single_header)
    else:
        data = spark.createDataFrame([], "value string, __store_idx int, __row_idx long, __pos long")
    return _typed(_guarded(data, p), p, len(names), kinds, kept, final)


def parse_rows(data: DataFrame, p: CsvParams) -> DataFrame:
    """Rows (value, __store_idx, __row_idx, __pos), a stream's too, as read_csv gives them, with the names of the
    parameters and their types, text where none is given. Nothing is read for it."""
    names = list(p.column_names)
    kinds = column_types(names, None, p)
    kept, final = _kept(names, p)
    return _typed(_guarded(data, p), p, len(names), kinds, kept, final)


def _kept(names: list[str], p: CsvParams) -> tuple[list[int], list[str]]:
    """Places of the columns that are kept, and their names."""
    kept = [i for i, name in enumerate(names) if (not p.use_columns or name in p.use_columns) and (not p.use_columns_by_index or i in p.use_columns_by_index)]
    final = [names[i] for i in kept]
    if p.dedupe_column_names:
        final = dedupe(final)
    elif len(set(final)) < len(final):
        raise SchemaError(f"duplicate column names: {final}")
    return kept, final


def _guarded(data: DataFrame, p: CsvParams) -> DataFrame:
    if not p.max_line_length:
        return data
    too_long = F.octet_length("value") >= p.max_line_length
    return data.withColumn("value", F.when(too_long, F.raise_error(F.lit("RecordTooLargeError: a line exceeds max_line_length"))).otherwise(F.col("value")))


def _typed(data: DataFrame, p: CsvParams, width: int, kinds: list[str], kept: list[int], final: list[str]) -> DataFrame:
    cell, why, note, told = _cells(data, p, width, kept)
    typed = [parse(cell(k), kinds[i], p.nan_values) for k, i in enumerate(kept)]
    own = ("__store_idx", "__row_idx", "__pos", "__bytes", "__note")
    told = told.select(
        *own[:3], F.octet_length("value").alias("__bytes"), note.alias("__note"), why.alias("__why"),
        *(F.substring(cell(k), 1, 64).alias(f"__t{k}") for k in range(len(kept))),
        *(t.cast(SPARK_TYPES[kinds[i]]).alias(f"__v{k}") for k, (i, t) in enumerate(zip(kept, typed, strict=True))),
    )
    said = lambda k: F.concat(F.lit(f"{final[k]} is not {kinds[kept[k]]}: '"), F.coalesce(f"__t{k}", F.lit("")), F.lit("'"))
    failed = F.array_join(F.array(*(F.when(F.col(f"__v{k}").isNull(), said(k)) for k in range(len(kept)))), "; ")
    bad = F.coalesce(F.col("__why"), F.when(failed != "", failed))
    return told.select(*(F.col(f"__v{k}").alias(name) for k, name in enumerate(final)), *own, bad.alias("__bad"))


def _cells(data: DataFrame, p: CsvParams, width: int, kept: list[int]) -> tuple[Callable[[int], Column], Column, Column, DataFrame]:
    """(k-th kept cell, why there are none, what was done, rows): lines without a quote are cut by Spark, only others and
    those that may hold too long a field go through the tokenizer, unless their fields came with them."""
    delimiter, quote, longest = p.delimiter, p.quote_char, p.max_field_length
    cut = p.max_field_length_handling is not MaxFieldLengthHandling.TREAT_AS_BAD

    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            out = []
            for line in values:
                if line is None:
                    out.append((None, None, None))
                    continue
                try:
                    own = tokenize(line, delimiter, quote)
                except CorruptRecordError as e:
                    out.append((None, str(e), None))
                    continue
                why = note = None
                if len(own) != width:
                    own, why = None, f"{len(own)} fields instead of {width}"
                else:
                    own = [own[i] for i in kept]
                    if longest is not None:
                        raw = [c.encode() for c in own]
                        if any(len(c) > longest for c in raw):
                            own, why, note = ([c[:longest].decode(errors="ignore") for c in raw], None, "a field was cut") if cut else (None, "a field is too long", None)
                out.append((own, why, note))
            yield pd.DataFrame(out, columns=["cells", "why", "note"])

    cells.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    value = F.col("value")
    hard = F.contains(value, F.lit(quote)) if quote else F.lit(False)
    if longest is not None:
        hard |= F.octet_length(value) > longest
    plain = F.split(value, "\\Q" + delimiter + "\\E")
    told = data.withColumns({"__hard": hard, "__plain": F.when(~hard, plain)})
    if not quote and longest is None:
        python = F.lit(None).cast("struct<cells:array<string>,why:string,note:string>")
    else:
        python = F.pandas_udf(cells, "cells array<string>, why string, note string")(F.when(F.col("__hard"), F.col("value")))
    if "fields" in data.columns and longest is None:
        many = F.size("fields")
        of = lambda k: F.when(many == width, F.get("fields", F.lit(kept[k])))
        fault, note = F.coalesce("unread", F.when(many != width, F.concat(many.cast("string"), F.lit(f" fields instead of {width}")))), F.lit(None).cast("string")
    else:
        told = told.withColumn("__c", python)
        of, fault, note = (lambda k: F.get("__c.cells", F.lit(k))), F.col("__c.why"), F.col("__c.note")
    short = F.size("__plain") != width
    cell = lambda k: F.when(F.col("__hard"), of(k)).when(~short, F.get("__plain", F.lit(kept[k])))
    why = F.when(F.col("__hard"), fault).when(short, F.concat(F.size("__plain").cast("string"), F.lit(f" fields instead of {width}")))
    warned = p.max_field_length_handling is MaxFieldLengthHandling.TRUNCATE_WARN
    return cell, why, note if warned else F.lit(None).cast("string"), told
