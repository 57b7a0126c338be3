"""Tensors on the driver: flat values with a shape, dense or by coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from rivulet.operators.sparse import to_csr
from rivulet.schema import default_strides


class DenseTensor:
    """shape, flat values and strides in elements; copy keeps the values from later changes."""

    def __init__(self, shape: Sequence[int], data, strides: Sequence[int] | None = None, copy: bool = True):
        self.shape = tuple(int(n) for n in shape)
        self.strides = default_strides(self.shape) if strides is None else tuple(strides)
        self.data = np.array(data) if copy else np.asarray(data)
        if len(self.strides) != len(self.shape):
            raise ValueError(f"{len(self.strides)} strides for {len(self.shape)} dimensions")
        need = 1 + sum((n - 1) * s for n, s in zip(self.shape, self.strides, strict=True)) if all(self.shape) else 0
        if self.data.ndim != 1 or len(self.data) < need:
            raise ValueError(f"{self.data.size} values for the shape {self.shape}")

    def numpy(self) -> np.ndarray:
        size = self.data.itemsize
        return np.lib.stride_tricks.as_strided(self.data, self.shape, [s * size for s in self.strides], writeable=False)


class CooTensor:
    """shape, values and the coordinates of each value, an array for each dimension."""

    def __init__(self, shape: Sequence[int], data, coords: Sequence, copy: bool = True):
        self.shape = tuple(int(n) for n in shape)
        take = np.array if copy else np.asarray
        self.data, self.coords = take(data), [take(c, dtype=np.int64) for c in coords]
        if len(self.coords) != len(self.shape):
            raise ValueError(f"{len(self.coords)} arrays of coordinates for {len(self.shape)} dimensions")
        if any(len(c) != len(self.data) for c in self.coords):
            raise ValueError("each value needs a coordinate in each dimension")
        if any(len(c) and not 0 <= c.min() <= c.max() < n for c, n in zip(self.coords, self.shape, strict=True)):
            raise ValueError("a coordinate is out of range")

    def indices(self, dim: int) -> np.ndarray:
        return self.coords[dim]

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, self.data.dtype)
        out[tuple(self.coords)] = self.data
        return out

    def csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, indices, indptr), later dimensions as one."""
        rest = self.shape[1:]
        columns = sum((c * s for c, s in zip(self.coords[1:], default_strides(rest), strict=True)), np.zeros(len(self.data), np.int64))
        return to_csr(self.data, self.coords[0], columns, self.shape[0]) if math.prod(rest) else to_csr(self.data[:0], self.coords[0][:0], columns[:0], self.shape[0])
