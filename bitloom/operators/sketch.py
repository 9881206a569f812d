"""Sketches: sets of bits, as rows (set_id, bit) or packed into 4,096 bytes.

A packed sketch is what bitmap_construct_agg and bitmap_or_agg make: bit i is bit i % 8 of byte i // 8. Building one is
an aggregation over a constant-size buffer, partial before the shuffle: what is shuffled is 4 KiB for each set and task,
however many tokens there are. Questions about one or two packed sketches are Arrow functions over whole columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.consts import BITMAP_BYTES, M, REG_BITS, TOTAL_BITS
from bitloom.functions.arrow import ROWS, bytes_of, joined, lists_of, packed_of, slices, udf
from bitloom.functions.hashing import found, reg_of, token_bits, tz_of

#: Partial sketches that a task holds at once: 16 MB.
HELD = 4096


def atoms(df: DataFrame, tokens: Column, *keys: str, seed: int = 0) -> DataFrame:
    """(keys, bit), distinct. Hashed within the rows, so only distinct bits of a row go on."""
    return df.select(*keys, F.explode(token_bits(tokens, seed)).alias("bit")).distinct()


def _combiner(n_keys: int):
    """Partial sketches of a task: a slice's distinct tokens are hashed once, and ORed into the sketch of each row's key.
    No more than HELD sketches are kept; those go out as they are, to be ORed after the shuffle."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            columns = list(zip(*held)) or [()] * n_keys
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [packed_of(np.stack(list(held.values())))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, [*names, "bm"])

        for batch in batches:
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            for at, n in slices(batch.column(n_keys)):
                part = batch.slice(at, n)
                row, bit = found(part.column(n_keys))
                slots: dict[tuple, int] = {}
                rows = zip(*(part.column(i).to_pylist() for i in range(n_keys))) if n_keys else [()] * n
                slot = np.array([slots.setdefault(k, len(slots)) for k in rows], np.int64)[row]
                for first in range(0, len(slots), ROWS):
                    own = (slot >= first) & (slot < first + ROWS)
                    made = packed(min(ROWS, len(slots) - first), slot[own] - first, bit[own])
                    for key, one in zip(list(slots)[first : first + ROWS], made):
                        held[key] = held[key] | one if key in held else one.copy()
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    return run


def build(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, bm): the sketch of each group's tokens. Groups without tokens have an empty sketch.

    Combined within each task, so that 4 KiB for each set and task are shuffled and nothing is sorted before."""
    rows = df.select(*keys, tokens.alias("tokens_"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("bm", T.BinaryType())])
    return rows.mapInArrow(_combiner(len(keys)), schema).groupBy(*keys).agg(F.bitmap_or_agg("bm").alias("bm"))


def of_tokens(tokens: Column | str, seed: int = 0) -> Column:
    """The packed sketch of a row's own tokens: hashed and packed in one call, without a shuffle. Null tokens: null."""

    def run(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), BITMAP_BYTES), np.uint8)
        for first, n in slices(lists, ROWS):
            out[first : first + n] = packed(n, *found(lists.slice(first, n), seed))
        return packed_of(out, lists.is_null())

    return udf("binary", run)(tokens)


def pack(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys, bm) from (keys, bit); a null bit sets nothing."""
    return bits.groupBy(*keys).agg(F.bitmap_construct_agg(F.col("bit")).alias("bm"))


def packed(n: int, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """n packed sketches with these bits of these rows."""
    flags = np.zeros((n, TOTAL_BITS), np.uint8)
    flags[row, bit] = 1
    return np.packbits(flags, axis=1, bitorder="little")


def matrix(values: pa.Array) -> np.ndarray:
    """Packed sketches as (n, 4096) bytes; null is empty."""
    at, raw = bytes_of(values.fill_null(bytes(BITMAP_BYTES)) if values.null_count else values)
    return raw[at[0] : at[-1]].reshape(-1, BITMAP_BYTES)


def _flags(bm: pa.Array):
    """The sketches' bits, one byte each, ROWS sketches at a time."""
    x = matrix(bm)
    for i in range(0, len(x), ROWS):
        yield np.unpackbits(x[i : i + ROWS], axis=1, bitorder="little")


def _positions(flags, n_rows: int) -> pa.Array:
    """The places that are set in each row of flags, ascending."""
    row, at = np.nonzero(flags)
    return lists_of(np.bincount(row, minlength=n_rows), at.astype(np.int32))


def tz_counts_of(x: np.ndarray) -> np.ndarray:
    """How many registers have each of the 32 bits: (n, 4096) bytes to (n, 32)."""
    out = np.empty((len(x), REG_BITS), np.int32)
    for i in range(0, len(x), ROWS):
        out[i : i + ROWS] = np.unpackbits(x[i : i + ROWS], axis=1, bitorder="little").reshape(-1, M, REG_BITS).sum(axis=1)
    return out


def cardinality_of(counts: np.ndarray) -> np.ndarray:
    """cardinality() of arrays of 32 counts: (.., 32) to (..). Of many rows, 4,096 at a time: the terms are 1 MB then."""
    if counts.ndim == 2 and len(counts) > 4096:
        return np.concatenate([cardinality_of(counts[i : i + 4096]) for i in range(0, len(counts), 4096)])
    n, c = float(M), counts.astype(np.float64)
    part = (c > 0) & (c < n)
    f = -n * np.log1p(-np.where(part, c, 0.0) / n)
    level = np.where(part.any(axis=-1), part.argmax(axis=-1), -1)[..., None]
    base, s = np.take_along_axis(f, np.maximum(level, 0), axis=-1), np.arange(REG_BITS)
    full = np.where(level > s, base * 2.0 ** (level - s), n * np.log(n))
    total = np.where(part, f, np.where(c == 0, 0.0, full)).sum(axis=-1)
    return np.maximum(np.floor(total + 0.5), 0.0)


def bits(bm: Column | str) -> Column:
    """The bits of a packed sketch, ascending."""
    return udf("array<int>", lambda s: joined([_positions(f, len(f)) for f in _flags(s)], pa.list_(pa.int32())))(bm)


def _rows(counts: np.ndarray) -> pa.Array:
    return lists_of(np.full(len(counts), counts.shape[1]), counts.ravel())


def tz_counts(bm: Column | str) -> Column:
    return udf("array<int>", lambda s: _rows(tz_counts_of(matrix(s))))(bm)


def pair_counts(a: Column | str, b: Column | str) -> Column:
    """Three arrays of 32 counts in a row: of a, of b, and of what they share. All measures of a pair follow from them."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = matrix(x), matrix(y)
        return _rows(np.hstack([tz_counts_of(p), tz_counts_of(q), tz_counts_of(p & q)]))

    return udf("array<int>", run)(a, b)


def combined(a: Column | str, b: Column | str, how: str) -> Column:
    """union, intersection, difference or symmetric_difference of two packed sketches."""
    ops = {"union": lambda p, q: p | q, "intersection": lambda p, q: p & q, "difference": lambda p, q: p & ~q, "symmetric_difference": lambda p, q: p ^ q}
    op = ops[how]
    return udf("binary", lambda x, y: packed_of(op(matrix(x), matrix(y))))(a, b)


def complement(bm: Column | str) -> Column:
    return udf("binary", lambda s: packed_of(~matrix(s)))(bm)


def empty() -> Column:
    return F.unhex(F.repeat(F.lit("00"), BITMAP_BYTES))


def popcount(bm: Column | str) -> Column:
    return F.bitmap_count(bm)


def is_empty(bm: Column | str) -> Column:
    return F.bitmap_count(bm) == 0


def registers_with(bm: Column | str, tz: int) -> Column:
    """The registers that have a bit, ascending."""
    return udf("array<int>", lambda s: joined([_positions(f[:, tz::REG_BITS], len(f)) for f in _flags(s)], pa.list_(pa.int32())))(bm)


def nonzero_registers(bm: Column | str) -> Column:
    """How many registers have any bit."""
    return udf("int", lambda s: pa.array(matrix(s).reshape(-1, M, REG_BITS // 8).any(axis=2).sum(axis=1).astype(np.int32)))(bm)


def has_bit(bm: Column, reg: int, tz: int) -> Column:
    i = reg * REG_BITS + tz
    byte = F.conv(F.hex(F.substring(bm, i // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(1 << (i % 8)) != 0


def memory_usage(popcounts: Column) -> Column:
    """Size of the serialized sketch: an array of 16-bit values, or above 4,096 of them a plain bitmap."""
    return F.when(popcounts == 0, 8).when(popcounts <= 4096, 16 + 2 * popcounts).otherwise(16 + TOTAL_BITS // 8).cast("long")


def cardinality(counts: Column) -> Column:
    """The estimate from the 32 counts of a sketch, rounded half away from zero.

    A count c below all registers adds f(c) = -M ln(1 - c / M). A full count is extrapolated from the lowest level that
    is neither empty nor full, L: f of that level times 2^(L - level) if L is above, else M ln M.
    """
    n = float(M)
    part = lambda c: (c > 0) & (c < M)
    f = lambda c: -n * F.ln(1.0 - F.when(part(c), c).otherwise(0) / n)

    def total(cs: Column) -> Column:
        def with_level(level: Column) -> Column:
            base = f(F.coalesce(F.get(cs, level), F.lit(0)))
            full = lambda s: F.when(level > s, base * F.pow(F.lit(2.0), level - s)).otherwise(F.lit(n * float(np.log(n))))
            terms = F.transform(cs, lambda c, s: F.when(c == 0, F.lit(0.0)).when(c < M, f(c)).otherwise(full(s)))
            return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

        level = F.array_position(F.transform(cs, part), True).cast("int") - 1
        return F.transform(F.array(level), with_level)[0]

    return F.greatest(F.round(F.transform(F.array(counts), total)[0]), F.lit(0.0))


def card(bm: Column | str) -> Column:
    return cardinality(tz_counts(bm))


# --- over rows (set_id, bit): every question here is a plain aggregation -------------------------------------------


def bit_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, tz, n) of all 32 levels, zeros included."""
    spine = rows.select(*keys).distinct().withColumn("tz", F.explode(F.sequence(F.lit(0), F.lit(REG_BITS - 1))))
    counts = rows.groupBy(*keys, tz_of(F.col("bit")).alias("tz")).agg(F.count("*").alias("n"))
    return spine.join(counts, [*keys, "tz"], "left").select(*keys, "tz", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dense_registers(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, reg, mask): the 32 bits of each register that has any."""
    return rows.groupBy(*keys, reg_of(F.col("bit")).alias("reg")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("mask"))


def from_dense(registers: DataFrame, *keys: str) -> DataFrame:
    """(keys, bit) from (keys, reg, mask); registers from 1,024 on are left out."""
    tz = F.explode(F.sequence(F.lit(0), F.lit(REG_BITS - 1)))
    rows = registers.filter((F.col("reg") >= 0) & (F.col("reg") < M)).withColumn("tz", tz)
    return rows.filter("shiftright(mask, tz) & 1 = 1").select(*keys, (F.col("reg") * REG_BITS + F.col("tz")).cast("int").alias("bit"))


def register_max(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, reg, max_tz): the registers of a classic sketch of distinct counts."""
    return rows.groupBy(*keys, reg_of(F.col("bit")).alias("reg")).agg(F.max(tz_of(F.col("bit"))).alias("max_tz"))


def register_popcounts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, reg, n) of all 1,024 registers, zeros included."""
    spine = rows.select(*keys).distinct().withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(M - 1))))
    counts = rows.groupBy(*keys, reg_of(F.col("bit")).alias("reg")).agg(F.count("*").alias("n"))
    return spine.join(counts, [*keys, "reg"], "left").select(*keys, "reg", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
