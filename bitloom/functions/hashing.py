"""Hashes and addresses: from a token to its 64-bit hash, and from a hash to one of the 32,768 bits.

The hash is MurmurHash3 x64-128, its low half. Spark has no such function, so it runs as an Arrow function over whole
columns of tokens (NumPy, all tokens of a batch at once); all that follows is built-in column arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.consts import M, P, REG_BITS, TOTAL_BITS
from bitloom.functions.arrow import bytes_of, joined, lists_of, slices, udf

_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
#: Bytes of tokens that are mixed at once.
LAID_OUT = 1 << 20
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _F1
    x = (x ^ (x >> np.uint64(33))) * _F2
    return x ^ (x >> np.uint64(33))


def _k1(x):
    return _rotl(x * _C1, 31) * _C2


def _k2(x):
    return _rotl(x * _C2, 33) * _C1


def murmur3(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    """The low 64 bits of each token's hash."""
    return murmur3_of(pa.array(tokens, pa.large_binary()), seed)


def murmur3_of(tokens: pa.Array, seed: int = 0) -> np.ndarray:
    """murmur3() of an Arrow array of strings or bytes without nulls. Tokens are laid out by their number of 16-byte blocks and
    mixed together, about LAID_OUT bytes at a time."""
    out = np.empty(len(tokens), np.uint64)
    at, raw = bytes_of(tokens)
    sizes = np.diff(at)
    width = sizes // 16 + 1  # in blocks, the last one zero-padded
    for w in np.unique(width):
        size = int(w) * 16
        every, windows = np.flatnonzero(width == w), np.lib.stride_tricks.sliding_window_view(np.concatenate([raw[at[0] : at[-1]], np.zeros(size, np.uint8)]), size)
        for first in range(0, len(every), max(1, LAID_OUT // size)):
            rows = every[first : first + max(1, LAID_OUT // size)]
            length = sizes[rows].astype(np.uint64)
            x = windows[at[rows] - at[0]]
            x *= np.arange(size) < sizes[rows][:, None]
            x = x.view("<u8")
            h1 = np.full(len(rows), seed & 0xFFFFFFFF, np.uint64)
            h2 = h1.copy()
            for b in range(int(w) - 1):
                h1 = (_rotl(h1 ^ _k1(x[:, 2 * b]), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
                h2 = (_rotl(h2 ^ _k2(x[:, 2 * b + 1]), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
            h1, h2 = h1 ^ _k1(x[:, -2]) ^ length, h2 ^ _k2(x[:, -1]) ^ length
            h1 = h1 + h2
            h2 = h2 + h1
            out[rows] = fmix(h1) + fmix(h2)
    return out


def positions(hashes: np.ndarray) -> np.ndarray:
    """Bit of each hash: register = low ten bits, tz = trailing zeros of the rest, 31 at most."""
    rest = (hashes >> np.uint64(P)) | np.uint64(1 << (REG_BITS - 1))
    low = rest & (~rest + np.uint64(1))
    return ((hashes & np.uint64(M - 1)).astype(np.int64) * REG_BITS + np.log2(low.astype(np.float64)).astype(np.int64)).astype(np.int32)


def hash64(token: Column | str, seed: int = 0) -> Column:
    """A token's hash, as the long with the same bits; null for null."""

    def run(values: pa.Array) -> pa.Array:
        known = np.asarray(values.is_valid())
        out = np.zeros(len(values), np.int64)
        out[known] = murmur3_of(values.drop_null(), seed).view(np.int64)
        return pa.array(out, mask=~known)

    return udf("long", run)(token)


def found(lists: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every token of an array of lists, nulls left out. Tokens that repeat are hashed once."""
    row, encoded = np.asarray(pc.list_parent_indices(lists)), lists.flatten().dictionary_encode()
    known, index = np.asarray(encoded.indices.is_valid()), np.asarray(encoded.indices.drop_null())
    return row[known], positions(murmur3_of(encoded.dictionary, seed))[index]


def token_bits(tokens: Column | str, seed: int = 0) -> Column:
    """The bits of an array of tokens, distinct and ascending; null for null. In each row by itself, no shuffle."""

    def part(lists: pa.Array) -> pa.Array:
        row, bit = found(lists, seed)
        both = np.unique(row.astype(np.int64) * TOTAL_BITS + bit)
        return lists_of(np.bincount(both // TOTAL_BITS, minlength=len(lists)), (both % TOTAL_BITS).astype(np.int32), lists.is_null())

    def run(lists: pa.Array) -> pa.Array:
        return joined([part(lists.slice(first, n)) for first, n in slices(lists)], pa.list_(pa.int32()))

    return udf("array<int>", run)(tokens)


def reg_of(bit: Column) -> Column:
    return F.shiftright(bit, 5)


def tz_of(bit: Column) -> Column:
    return bit.bitwiseAND(REG_BITS - 1)


def address(reg: Column, tz: Column) -> Column:
    """The flat bit of (register, tz); an error where either is out of range."""
    sound = (reg >= 0) & (reg < M) & (tz >= 0) & (tz < REG_BITS)
    return F.when(sound, reg * REG_BITS + tz).otherwise(F.raise_error(F.lit("no such bit"))).cast("int")


def checked_bit(bit: Column) -> Column:
    return F.when((bit >= 0) & (bit < TOTAL_BITS), bit).otherwise(F.raise_error(F.lit("no such bit"))).cast("int")


def bit_of_hash(h: Column) -> Column:
    """Built-in form of positions(): 31 stands in for a rest without any of its low bits set."""
    rest = F.shiftrightunsigned(h, P).bitwiseOR(F.lit(1 << (REG_BITS - 1)).cast("long"))
    tz = F.bit_count(rest.bitwiseAND(-rest) - 1)
    return (h.bitwiseAND(M - 1) * REG_BITS + tz).cast("int")


def bit_of(token: Column | str, seed: int = 0) -> Column:
    return bit_of_hash(hash64(token, seed))


def token_text(n: Column) -> Column:
    """tid{n}"""
    return F.concat(F.lit("tid"), n.cast("string"))


def parse_token_text(token: Column) -> Column:
    """n of tid{n}; null where it is malformed or no unsigned 32-bit number."""
    n = F.regexp_extract(token, r"^tid\+?([0-9]{1,18})$", 1).try_cast("long")
    return F.when(n < 2**32, n)


def token_le(n: Column) -> Column:
    """The four bytes of n, lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


def parse_token_le(token: Column) -> Column:
    """n of four bytes; null for any other length."""
    n = F.conv(F.regexp_replace(F.hex(token), "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")
    return F.when(F.octet_length(token) == 4, n)
