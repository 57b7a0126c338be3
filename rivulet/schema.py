"""What a reader yields: named attributes with a type, a shape for one row, and whether they are sparse."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql.types import ArrayType, LongType, StructField, StructType, _parse_datatype_string

from rivulet.functions.parsing import SPARK_TYPES


def default_strides(shape: Sequence[int]) -> tuple[int, ...]:
    """Elements, not bytes, between neighbours of each dimension; the last dimension is the densest."""
    return tuple(math.prod(shape[i + 1 :]) for i in range(len(shape)))


@dataclass(frozen=True)
class Attribute:
    name: str
    data_type: str
    shape: tuple[int, ...] = (1,)
    strides: tuple[int, ...] | None = None
    sparse: bool = False

    def __post_init__(self):
        if self.data_type not in SPARK_TYPES:
            raise ValueError(f"unknown data type {self.data_type!r}")
        object.__setattr__(self, "shape", tuple(self.shape))
        strides = default_strides(self.shape) if self.strides is None else tuple(self.strides)
        if len(strides) != len(self.shape):
            raise ValueError(f"{self.name}: {len(strides)} strides for {len(self.shape)} dimensions")
        object.__setattr__(self, "strides", strides)

    def field(self) -> StructField:
        """A dense attribute is an array in row-major order, a sparse one its linear keys and values."""
        values = ArrayType(_parse_datatype_string(SPARK_TYPES[self.data_type]))
        kind = StructType([StructField("keys", ArrayType(LongType())), StructField("values", values)]) if self.sparse else values
        return StructField(self.name, kind, metadata={"shape": list(self.shape), "strides": list(self.strides), "sparse": self.sparse})


@dataclass(frozen=True)
class Schema:
    attributes: tuple[Attribute, ...]

    def __post_init__(self):
        object.__setattr__(self, "attributes", tuple(self.attributes))
        names = [a.name for a in self.attributes]
        if len(set(names)) < len(names):
            raise ValueError(f"names are not unique: {names}")

    def get_index(self, name: str) -> int | None:
        return next((i for i, a in enumerate(self.attributes) if a.name == name), None)

    def struct(self) -> StructType:
        return StructType([a.field() for a in self.attributes])
