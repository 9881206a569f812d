"""Functions over Arrow columns in slices: what a task holds at once depends neither on the table nor on the size of a batch.

Tokens stay in Arrow's buffers, from the batch to their hashes: no Python object is made for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bitloom.consts import BITMAP_BYTES

#: Tokens that a slice has at most (a row of more is a slice by itself), and rows whose sketches are unpacked at once (8 MB).
TOKENS, ROWS = 1 << 18, 256


def udf(kind: str, f: Callable) -> Callable:
    """f(arrays) -> array as a function of columns."""

    def run(*columns):
        return f(*columns)

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def slices(lists: pa.Array, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of a column of lists with TOKENS tokens and so many rows at most."""
    ends, first = np.asarray(lists.offsets).astype(np.int64), 0
    while first < len(lists):
        last = int(np.searchsorted(ends, ends[first] + TOKENS, "right")) - 1
        n = min(max(last - first, 1), rows, len(lists) - first)
        yield first, n
        first += n


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings or bytes."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if offsets else np.zeros(1)
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def lists_of(sizes: np.ndarray, values: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """An array of lists of so many of the values each; null where null has it."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=null)


def packed_of(sketches: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """An array of packed sketches from (n, 4096) bytes, which it shares."""
    n = len(sketches)
    valid = pa.py_buffer(np.packbits(~np.asarray(null), bitorder="little")) if null is not None and n else None
    offsets = np.arange(n + 1, dtype=np.int32) * BITMAP_BYTES
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sketches))])


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
