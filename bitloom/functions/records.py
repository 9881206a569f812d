"""Serialized forms: portable compressed bitmaps, the dense block, frequency vectors, commits, modules, handshakes."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.consts import BITMAP_BYTES, M, MODULE_PORTS, TOTAL_BITS
from bitloom.functions.arrow import ROWS, slices, udf
from bitloom.functions.hashing import found
from bitloom.operators.sketch import matrix

_COOKIE, _ARRAY_MOST = 12346, 4096


def to_bytes_of(bits: np.ndarray) -> bytes:
    """The portable format of a bitmap of 32-bit values below 65,536: one container or none.

    Cookie, number of containers, then key and cardinality - 1 and the offset of the container: up to 4,096 values as
    16-bit numbers, more as 8 KiB of bits.
    """
    n = len(bits)
    if not n:
        return struct.pack("<II", _COOKIE, 0)
    head = struct.pack("<IIHHI", _COOKIE, 1, 0, n - 1, 16)
    if n <= _ARRAY_MOST:
        return head + np.asarray(bits, "<u2").tobytes()
    body = np.zeros(65536, np.uint8)
    body[bits] = 1
    return head + np.packbits(body, bitorder="little").tobytes()


def from_bytes_of(data: bytes) -> np.ndarray | None:
    """The values; None where the bytes are malformed."""
    try:
        cookie, n = struct.unpack_from("<II", data)
        if cookie != _COOKIE or n > 1:
            return None
        if n == 0:
            return np.empty(0, np.int32)
        key, last, at = struct.unpack_from("<HHI", data, 8)
        if last < _ARRAY_MOST:
            values = np.frombuffer(data, "<u2", last + 1, at).astype(np.int32)
        else:
            values = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little")).astype(np.int32)
        return values + (key << 16)
    except (struct.error, ValueError):
        return None


def _udf(kind: str, f) -> object:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(f(values), index=values.index)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def to_bytes(bm: Column | str) -> Column:
    """Packed sketch to portable bytes."""
    return udf("binary", lambda s: pa.array([to_bytes_of(np.flatnonzero(np.unpackbits(r, bitorder="little"))) for r in matrix(s)], pa.binary()))(bm)


def from_bytes(data: Column | str) -> Column:
    """Portable bytes to a packed sketch; null where malformed. Values beyond the sketch's bits are left out."""

    def one(v):
        values = None if v is None else from_bytes_of(bytes(v))
        if values is None:
            return None
        out = np.zeros(TOTAL_BITS, np.uint8)
        out[values[values < TOTAL_BITS]] = 1
        return np.packbits(out, bitorder="little").tobytes()

    return _udf("binary", lambda s: [one(v) for v in s])(data)


def content_hash(bm: Column | str) -> Column:
    return F.sha1(to_bytes(bm))


def bitmap_key(bm: Column | str) -> Column:
    """h: and the sha1 of the portable bytes. It never equals the token key of the same tokens."""
    return F.concat(F.lit("h:"), content_hash(bm))


def _keyed(n_keys: int):
    """bitmap_key() of the tokens in a batch's last column, a slice of rows at a time."""

    def run(batches):
        for batch in batches:
            for first, n in slices(batch.column(n_keys), ROWS):
                part = batch.slice(first, n)
                flags = np.zeros((n, TOTAL_BITS), np.uint8)
                flags[found(part.column(n_keys))] = 1
                keys = [f"h:{hashlib.sha1(to_bytes_of(np.flatnonzero(f))).hexdigest()}" for f in flags]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], pa.array(keys, pa.string())], [*part.schema.names[:n_keys], "key"])

    return run


def bitmap_keys(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, key): bitmap_key() of each row's own tokens, where no more than a few rows are unpacked at once. Null tokens
    are none."""
    rows = df.select(*keys, tokens.alias("tokens_"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("key", T.StringType())])
    return rows.mapInArrow(_keyed(len(keys)), schema)


def to_bytes_native(bits: Column) -> Column:
    """to_bytes() of an array of up to 4,096 ascending bits in built-in functions."""
    le2 = lambda x: F.regexp_replace(F.lpad(F.hex(x.cast("long")), 4, "0"), "(..)(..)", "$2$1")
    head = F.concat(F.lit("3A300000010000000000"), le2(F.size(bits) - 1), F.lit("10000000"))
    return F.unhex(F.when(F.size(bits) == 0, F.lit("3A30000000000000")).otherwise(F.concat(head, F.array_join(F.transform(bits, le2), ""))))


def tf_bytes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bytes) of (keys, bit, tf): the length, 32,768, then all values as 64-bit floats, lowest byte first."""

    def one(pairs) -> bytes:
        out = np.zeros(TOTAL_BITS, "<f8")
        for p in pairs:
            out[p["bit"]] = p["tf"]
        return struct.pack("<I", TOTAL_BITS) + out.tobytes()

    sets = rows.groupBy(*keys).agg(F.collect_list(F.struct("bit", F.col("tf").cast("double").alias("tf"))).alias("pairs"))
    return sets.select(*keys, _udf("binary", lambda s: [one(v) for v in s])("pairs").alias("bytes"))


def tf_from_bytes(data: bytes) -> np.ndarray | None:
    """None where the length is another or the bytes are too few; what follows the values is ignored."""
    if len(data) < 4 + 8 * TOTAL_BITS or struct.unpack_from("<I", data)[0] != TOTAL_BITS:
        return None
    return np.frombuffer(data, "<f8", TOTAL_BITS, 4)


def dense_block(bm: Column, name: bytes) -> Column:
    """The documented block of 4,116 bytes, for export: a format's name in eight bytes, its version, the numbers of
    registers and of their bits, then the registers."""
    head = name.ljust(8, b"\0")[:8] + struct.pack("<III", 1, M, 32)
    return F.concat(F.lit(bytearray(head)), F.substring(bm, 1, BITMAP_BYTES))


def commit_json(ts: Column, s: Column, h: Column, d: Column, r: Column, n: Column) -> Column:
    """A commit as JSON, in the order of its declaration."""
    return F.to_json(F.struct(ts.cast("long").alias("ts"), s.alias("s"), h.alias("h"), d.alias("d"), r.alias("r"), n.alias("n")))


def commit_from_json(text: str) -> dict | None:
    try:
        found = json.loads(text)
        return found if set("shdrn") | {"ts"} <= set(found) and isinstance(found["ts"], int) else None
    except (ValueError, TypeError):
        return None


def commit_key(json_text: Column) -> Column:
    return F.concat(F.lit("t:"), F.sha1(json_text.cast("binary")))


def module_ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, o) for k, (i, o) in MODULE_PORTS.items()], "kind string, inputs int, outputs int")


def port_in_range(kind: str, port: int, output: bool = False) -> bool:
    return 0 <= port < MODULE_PORTS[kind][output]


def handshake(valid: Column, ready: Column) -> Column:
    """(fire, stalled) of one beat."""
    return F.struct((valid & ready).alias("fire"), (valid & ~ready).alias("stalled"))
