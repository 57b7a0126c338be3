"""Batches and records one by one on the driver, in order: peek, epochs, arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row

#: Columns of a batch that are not features.
BATCH = ("batch_id", "size", "padding")


class Example(Mapping):
    """A batch as a mapping of its features, in order; batch_id, size and padding are attributes, and also found by
    name. A number finds the feature at that place."""

    def __init__(self, row: Row):
        self._row = row
        self.features = tuple(c for c in row.__fields__ if c not in BATCH and not c.startswith("__"))
        self.batch_id, self.size, self.padding = row["batch_id"], row["size"], row["padding"]

    def __getitem__(self, key: str | int):
        if isinstance(key, int):
            if not -len(self.features) <= key < len(self.features):
                raise KeyError(key)
            return self._row[self.features[key]]
        if key not in self.features and key not in BATCH:
            raise KeyError(key)
        return self._row[key]

    def __contains__(self, key: object) -> bool:
        return key in self.features

    def __len__(self) -> int:
        return len(self.features)

    def __iter__(self) -> Iterator[str]:
        return iter(self.features)

    def __repr__(self) -> str:
        return f"Example(batch_id={self.batch_id}, size={self.size}, padding={self.padding}, features={list(self.features)})"

    def asDict(self) -> dict:
        return {**{c: self._row[c] for c in BATCH}, **dict(self)}


class Ordered:
    """Rows of a DataFrame in order, one partition held at a time, with one ahead."""

    def __init__(self, df: DataFrame, order: str):
        self._rows: Iterator[Row] = df.orderBy(order).toLocalIterator(prefetchPartitions=True)
        self._ahead: list[Row] = []

    def peek(self) -> Row | None:
        if not self._ahead and (row := next(self._rows, None)) is not None:
            self._ahead.append(row)
        return self._ahead[0] if self._ahead else None

    def read(self) -> Row | None:
        row = self.peek()
        self._ahead.clear()
        return row

    def __iter__(self) -> Iterator[Row]:
        while (row := self.read()) is not None:
            yield row


class Examples:
    """Iterates over the batches of make(epoch); reset begins the next epoch."""

    def __init__(self, make: Callable[[int], DataFrame]):
        self.make, self.epoch = make, 0
        self._own = Ordered(make(0), "batch_id")

    def peek(self) -> Example | None:
        row = self._own.peek()
        return None if row is None else Example(row)

    def read(self) -> Example | None:
        row = self._own.read()
        return None if row is None else Example(row)

    def __iter__(self) -> Iterator[Example]:
        while (example := self.read()) is not None:
            yield example

    def reset(self) -> None:
        self.epoch += 1
        self._own = Ordered(self.make(self.epoch), "batch_id")


class Records(Ordered):
    """Records (payload) of a store's records DataFrame, in order: read_record, peek_record, iteration."""

    def __init__(self, df: DataFrame, pos: str = "__pos"):
        super().__init__(df, pos)

    read_record, peek_record = Ordered.read, Ordered.peek


def as_numpy(example: Mapping | Row, column: str, shape: tuple[int, ...] = ()) -> np.ndarray:
    """A dense column as (rows, *shape)."""
    own = np.asarray(example[column])
    return own.reshape(len(example[column]), *shape) if shape else own


def to_pandas(example: Example | Row) -> pd.DataFrame:
    return pd.DataFrame({k: v for k, v in example.asDict().items() if isinstance(v, list)})
