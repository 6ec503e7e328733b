"""What the operators on whole-number vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.llm.text import named

_LIMIT = 1 << 31


def whole(embeddings: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, whole array<int>): floor(scale * x) of each part x as double; rows whose vector is null or has null or non-finite parts go.

    Parts beyond 31 bits stop at their bounds, so that no score overflows.
    """
    parts = named(vector).cast("array<double>")
    usable = parts.isNotNull() & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cut = F.transform(parts, lambda x: F.greatest(F.least(F.floor(x * float(scale)), F.lit(_LIMIT - 1)), F.lit(-_LIMIT)).cast("int"))
    return embeddings.where(usable).select(named(vec_id).alias("vec_id"), named(label).alias("label"), cut.alias("whole"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths, out = np.diff(ends), np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = values[ends[0] : ends[-1]]
    return out


def numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which products of their rows are exact: doubles below 2^53, Python's integers beyond."""
    peak = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    kind = np.float64 if 4 * peak * peak * max(1, arrays[0].shape[-1]) < 1 << 53 else object
    return [a.astype(kind) for a in arrays]


def longs(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what is beyond stops at their bounds."""
    return values.astype(np.int64) if values.dtype != object else np.clip(values, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def blocked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size`, but for the last."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
