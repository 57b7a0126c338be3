"""Batches and records as arrays of other libraries. Those that are not installed are asked for when used."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from rivulet.errors import NotSupportedError
from rivulet.sources.stores import DataStore, File, compression_of, inflate, name_of

from .examples import as_numpy
from .tensors import CooTensor, DenseTensor


to_numpy = as_numpy


def to_tensor(array: np.ndarray) -> DenseTensor:
    """An array as its shape, strides in elements and flat values."""
    own = np.asarray(array)
    return DenseTensor(own.shape, own.reshape(-1))


def to_coo_matrix(example: Row | Mapping):
    """A coordinate batch (shape, data, coords) as a sparse matrix; one dimension becomes a single row."""
    from scipy.sparse import coo_matrix

    coords = [np.asarray(c, np.int64) for c in example["coords"]]
    if len(coords) > 2:
        raise NotSupportedError("matrices have two dimensions at most")
    if len(coords) == 1:
        coords = [np.zeros_like(coords[0]), coords[0]]
    shape = tuple(example["shape"]) if len(example["shape"]) == 2 else (1, example["shape"][0])
    return coo_matrix((np.asarray(example["data"]), tuple(coords)), shape=shape)


#: Fixed value: version 1.0 of the exchange format, its major number above its minor.
DLPACK = 0x10


def as_dlpack(array: np.ndarray, version: int = DLPACK):
    """Dense numbers only, of major version 1."""
    if version >> 4 != 1:
        raise NotSupportedError(f"version {version:#x} of the exchange format")
    own = np.asarray(array)
    if own.dtype.kind not in "iuf":
        raise NotSupportedError(f"{own.dtype} has no such form")
    return own.__dlpack__()


def as_torch(array: np.ndarray):
    import torch

    return torch.from_numpy(np.ascontiguousarray(array))


def as_mxnet(array: np.ndarray):
    import mxnet

    return mxnet.nd.from_numpy(np.ascontiguousarray(array))


def to_tf(array: np.ndarray | CooTensor):
    """Sparse ones too."""
    import tensorflow

    if isinstance(array, CooTensor):
        at = np.stack([array.indices(i) for i in range(len(array.shape))], axis=1)
        return tensorflow.sparse.SparseTensor(at, array.data, array.shape)
    return tensorflow.convert_to_tensor(array)


def make_tf_dataset(examples: Iterator[Row], features: Sequence[str], dtypes: Sequence):
    import tensorflow

    rows = lambda: (tuple(as_numpy(e, f) for f in features) for e in examples)
    return tensorflow.data.Dataset.from_generator(rows, tuple(dtypes))


def as_arrow_file(payload: bytes | File | DataStore | str) -> pa.NativeFile:
    """A record or a store as a file for Arrow's readers."""
    if isinstance(payload, (bytes, bytearray)):
        return pa.BufferReader(bytes(payload))
    if isinstance(payload, DataStore):
        with payload.open_read() as stream:
            data = stream.read()
        return pa.BufferReader(inflate(data) if payload.compression == "gzip" else data)
    path = name_of(payload)
    kind = getattr(payload, "compression", "infer")
    if (compression_of(path) if kind == "infer" else kind) == "gzip":
        with open(path, "rb") as f:
            return pa.BufferReader(inflate(f.read()))
    return pa.memory_map(path)
