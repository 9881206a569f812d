"""How many n-grams groups of texts have, in all and distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions.arrow import slices
from bitloom.functions.hashing import fmix, murmur3_of

#: Digests that a task holds at once (32 MB); parts of a group's digests, by their highest bits, that are counted one by one.
HELD, PARTS = 1 << 21, 1 << 12
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _distinct(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order of distinct digests by group and value."""
    width = np.uint64(int(group.max(initial=0)).bit_length())
    place = x["a"] >> width
    if width:
        place |= group.astype(np.uint64) << (np.uint64(64) - width)
    order = np.argsort(place)
    s, a, b = place[order], x["a"][order], x["b"][order]
    near = s[1:] == s[:-1]
    same = near & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    if (near & ~same).any():  # others of one place may stand between two that are equal
        order = np.lexsort((x["b"], x["a"], group))
        g, a, b = group[order], x["a"][order], x["b"][order]
        same = (g[1:] == g[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order[np.concatenate([[True], ~same])] if len(order) else order


def _digests(n_sizes: range):
    """Of batches (key, tokens) rows (key, n, part, size, digests): a task's distinct n-grams as 128-bit digests, HELD at a time,
    and with the first row of a group how many n-grams they stand for."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        keys: dict = {}
        size: dict[int, int] = {}
        kind = None

        def merged() -> None:
            if len(held) > 1:
                group, x = (np.concatenate(c) for c in zip(*held))
                order = _distinct(group, x)
                held[:] = [(group[order], x[order])]

        def out() -> pa.RecordBatch:
            merged()
            group, x = held[0]
            place = group.astype(np.int64) * PARTS + (x["a"] >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            group, part = place[first] // PARTS, place[first] % PARTS
            fresh = np.concatenate([[True], group[1:] != group[:-1]])
            sizes = np.zeros(len(first), np.int64)
            sizes[fresh] = [size[g] for g in group[fresh]]
            names = pa.array(list(keys), kind).take(pa.array(group // len(n_sizes)))
            ends = (np.concatenate([first, [len(x)]]) * _DIGEST.itemsize).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            n = np.array(n_sizes, np.int32)[group % len(n_sizes)]
            held.clear(), keys.clear(), size.clear()
            return pa.RecordBatch.from_arrays([names, pa.array(n), pa.array(part.astype(np.int32)), pa.array(sizes), blobs], ["key", "n", "part", "size", "digests"])

        for batch in batches:
            kind = batch.schema.types[0]
            for at, n_rows in slices(batch.column(1)):
                part = batch.slice(at, n_rows)
                own = np.array([keys.setdefault(k, len(keys)) for k in part.column(0).to_pylist()], np.int64)
                row, encoded = np.asarray(pc.list_parent_indices(part.column(1))), part.column(1).flatten().dictionary_encode()
                row, index = row[np.asarray(encoded.indices.is_valid())], np.asarray(encoded.indices.drop_null())
                grams = h = [murmur3_of(encoded.dictionary, seed)[index] for seed in (0, 1)]
                for n in range(1, n_sizes[-1] + 1):
                    if n > 1:
                        grams = [fmix(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + y[n - 1 :]) for x, y in zip(grams, h)]
                    if n < n_sizes[0] or not len(grams[0]):
                        continue
                    whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
                    group = own[row[whole]] * len(n_sizes) + (n - n_sizes[0])
                    x = np.empty(len(whole), _DIGEST)
                    x["a"], x["b"] = grams[0][whole], grams[1][whole]
                    counts = np.bincount(group)
                    for g in np.flatnonzero(counts):
                        size[int(g)] = size.get(int(g), 0) + int(counts[g])
                    order = _distinct(group, x)
                    if len(order):
                        held.append((group[order].astype(np.int32), x[order]))
                if sum(len(g) for g, _ in held) >= HELD:
                    merged()
                    if len(held[0][0]) >= HELD // 2:
                        yield out()
        if held:
            yield out()

    return run


def _counted(batches):
    """(key, n, size, distinct) of rows that are sorted by group and part: each part is counted by itself."""
    names = ["key", "n", "size", "n_distinct"]
    last, blobs, size, schema = None, [], 0, None

    def out() -> pa.RecordBatch:
        x = np.frombuffer(b"".join(blobs), _DIGEST)
        n = len(_distinct(np.zeros(len(x), np.int64), x))
        return pa.RecordBatch.from_arrays([pa.array([last[0]], schema.types[0]), pa.array([last[1]], pa.int32()), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names)

    for batch in batches:
        schema = batch.schema
        for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if last is not None and place != last:
                yield out()
                blobs, size = [], 0
            last = place
            blobs.append(batch.column(4)[i].as_buffer())
            size += batch.column(3)[i].as_py()
    if last is not None:
        yield out()


def counts(df: DataFrame, tokens: Column, key: str, sizes: range) -> DataFrame:
    """(key, n, total, n_distinct) of the n-grams of these sizes. What is shuffled are 16 bytes for each n-gram that a task finds
    distinct among those it holds, packed by group and part, and not texts or rows; a part is counted in one place, by sorting."""
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    fields = [T.StructField("key", kind), T.StructField("n", T.IntegerType())]
    packed = rows.mapInArrow(_digests(sizes), T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("digests", T.BinaryType())]))
    parts = packed.repartition("key", "n", "part").sortWithinPartitions("key", "n", "part")
    found = parts.mapInArrow(_counted, T.StructType([*fields, T.StructField("size", T.LongType()), T.StructField("n_distinct", T.LongType())]))
    return found.groupBy(F.col("key").alias(key), "n").agg(F.sum("size").alias("total"), F.sum("n_distinct").alias("n_distinct"))
