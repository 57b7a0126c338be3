"""Strings to numbers as the readers understand them: null where the text does not parse."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
#: Whole cells; possessive, so that a long run of digits is read once.
FLOAT = r"[+-]?(?:(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|[nN][aA][nN])"
INTEGER = r"[+-]?[0-9]++"
#: Integer types, their Spark type and bounds.
INTEGERS = {
    "int8": ("byte", -(2**7), 2**7 - 1), "int16": ("short", -(2**15), 2**15 - 1), "int32": ("int", -(2**31), 2**31 - 1), "int64": ("long", -(2**63), 2**63 - 1),
    "uint8": ("short", 0, 2**8 - 1), "uint16": ("int", 0, 2**16 - 1), "uint32": ("long", 0, 2**32 - 1), "uint64": ("decimal(20,0)", 0, 2**64 - 1), "size": ("decimal(20,0)", 0, 2**64 - 1),
}
SPARK_TYPES = {k: v[0] for k, v in INTEGERS.items()} | {"float32": "float", "float64": "double", "float16": "float", "string": "string"}


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def parse(c: Column, kind: str, nan_values: frozenset[str] = frozenset()) -> Column:
    """The value of a cell, or null. Infinities do not parse; float16 never does."""
    if kind == "string":
        return c
    text = trim(c)
    if kind in INTEGERS:
        spark_type, low, high = INTEGERS[kind]
        wide = text.try_cast("decimal(38,0)")
        return F.when(_whole(text, INTEGER) & wide.between(F.lit(Decimal(low)), F.lit(Decimal(high))), wide.cast(spark_type))
    if kind == "float16":
        return F.lit(None).cast("float")
    if kind not in ("float32", "float64"):
        raise ValueError(f"unknown data type {kind!r}")
    spark_type = SPARK_TYPES[kind]
    value = F.when(_whole(text, FLOAT), text.try_cast(spark_type))
    value = F.when((value != float("inf")) & (value != float("-inf")), value)
    if nan_values:
        value = F.coalesce(value, F.when(text.isin(*nan_values), F.lit(float("nan")).cast(spark_type)))
    return value


def infer_data_type(text: str) -> str:
    """The type of one cell: int64, then uint64 where that overflows, float64, else string."""
    own = text.strip(SPACE)
    if re.fullmatch(INTEGER, own):
        if -(2**63) <= int(own) < 2**63:
            return "int64"
        if 0 <= int(own) < 2**64:
            return "uint64"
    if re.fullmatch(FLOAT, own) and abs(float(own)) != float("inf"):
        return "float64"
    return "string"
