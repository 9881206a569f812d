"""Reverse index from bits to tokens, ingestion, restoration of tokens, term frequencies and ranks.

Tables: lut_index (lut_label, seed, bit, token) distinct; tf (token, n). All is joins on bit or token and aggregations;
the frequency of bits halves with each level, so joins on bit are skewed to level 0, which adaptive skew joins split.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.consts import EMPTY_TREE, REG_BITS, SEEDS
from bitloom.functions.hashing import bit_of, reg_of


def occurrences(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, token), one row for each occurrence."""
    return df.select(*keys, F.explode(tokens).alias("token"))


def tf_table(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n): how often each token occurs."""
    return rows.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def tf_merge(*tables: DataFrame) -> DataFrame:
    """Pointwise maximum of tables (token, n)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("token").agg(F.max("n").alias("n"))


def tf_bits(bits: DataFrame, delta: float = 1.0) -> DataFrame:
    """(bit, tf): delta for each time a bit occurs."""
    return bits.groupBy("bit").agg((F.count("*") * delta).alias("tf"))


def tf_bits_merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("bit").agg(F.max("tf").alias("tf"))


def build(tokens: DataFrame, *keys: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """lut_index of (keys, token): each distinct token is hashed once for each seed."""
    distinct = tokens.select(*keys, "token").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), bit_of("token", s).alias("bit")) for s in seeds)))
    return distinct.select(*keys, "token", each.alias("at")).select(*keys, "at.seed", "at.bit", "token")


def ingest(df: DataFrame, tokens: Column, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketch bits (keys, seed, bit), lut_index, tf) of a table of texts, all from one count of its tokens."""
    tf = tf_table(occurrences(df, tokens, *keys), *keys)
    index = build(tf, *keys)
    return index.select(*keys, "seed", "bit").distinct(), index, tf


def fiber(index: DataFrame, bit: int, seed: int = 0) -> DataFrame:
    """The tokens of one bit."""
    return index.filter((F.col("bit") == bit) & (F.col("seed") == seed)).select("token").distinct()


def node_union(a: DataFrame, b: DataFrame, label_a: str, label_b: str) -> tuple[str, DataFrame]:
    """Union of two labelled sets of tokens, and its label."""
    return f"{label_a}∪{label_b}", a.select("token").unionByName(b.select("token")).distinct()


def restore(bits: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """(keys, token): every token of every bit's fiber, without regard to frequencies (a slice or a gate)."""
    on = ["seed", "bit"] if "seed" in bits.columns else ["bit"]
    fibers = index.select(*on, "token").distinct()
    return bits.select(*keys, *on).join(fibers, on).select(*keys, "token").distinct()


def materialize(bits: DataFrame, index: DataFrame, tf: DataFrame, *keys: str) -> DataFrame:
    """(keys, token): one token for each bit. Candidates of all seeds meet on the flat bit; the most frequent one wins,
    of equally frequent ones the largest by its bytes; a token without a frequency counts 0."""
    candidates = bits.select(*keys, "seed", "bit").join(index.select("seed", "bit", "token"), ["seed", "bit"])
    candidates = candidates.select(*keys, "bit", "token").distinct().join(tf.select("token", "n"), "token", "left")
    won = candidates.groupBy(*keys, "bit").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("best"))
    return won.select(*keys, F.col("best.token").alias("token")).distinct()


def consensus(bits: DataFrame, index: DataFrame, least: int = 2) -> DataFrame:
    """Tokens whose bits are set under at least so many seeds."""
    hits = bits.select("seed", "bit").distinct().join(index, ["seed", "bit"]).groupBy("token").agg(F.count_distinct("seed").alias("n_seeds"))
    return hits.filter(F.col("n_seeds") >= least)


# --- ranks: fold(sum, max or min) at every level, empty folds are 0 ------------------------------------------------


def fold(how: str, value: Column) -> Column:
    return F.coalesce({"sum": F.sum, "max": F.max, "min": F.min}[how](value), F.lit(0)).cast("long")


def bit_rank(index: DataFrame, tf: DataFrame, how: str, seed: int = 0) -> DataFrame:
    """(bit, rank) of every bit with a fiber."""
    one = index.filter(F.col("seed") == seed).select("bit", "token").distinct()
    return one.join(tf, "token", "left").groupBy("bit").agg(fold(how, F.coalesce("n", F.lit(0))).alias("rank"))


def register_rank(ranks: DataFrame, how: str) -> DataFrame:
    """(reg, rank) of every register with a fiber: over all of its 32 bits, those without a fiber count 0."""
    n = ranks.groupBy(reg_of(F.col("bit")).alias("reg")).agg(fold(how, F.col("rank")).alias("rank"), F.count("*").alias("n"))
    least = F.when(F.col("n") < REG_BITS, F.least("rank", F.lit(0))).otherwise(F.col("rank"))
    return n.select("reg", (least if how == "min" else F.col("rank")).cast("long").alias("rank"))


def set_rank(bits: DataFrame, ranks: DataFrame, how: str, *keys: str) -> DataFrame:
    """(keys, rank) over each set's bits; bits without a fiber count 0."""
    return bits.join(ranks, "bit", "left").groupBy(*keys).agg(fold(how, F.coalesce("rank", F.lit(0))).alias("rank"))


def compound_rank(set_ranks: DataFrame, how: str, *keys: str) -> DataFrame:
    return set_ranks.groupBy(*keys).agg(fold(how, F.col("rank")).alias("rank"))


# --- Merkle roots over a set's sorted bits -------------------------------------------------------------------------


def merkle_root_of(bits) -> str:
    """Leaves are sha1(00 and the bit in four bytes, lowest first), nodes sha1(01 and both children's hex text); of an odd
    level the last is paired with itself."""
    level = [hashlib.sha1(b"\0" + int(b).to_bytes(4, "little")).hexdigest() for b in bits]
    if not level:
        return hashlib.sha1(EMPTY_TREE.encode()).hexdigest()
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha1(b"\1" + (level[i] + level[i + 1]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


def merkle_root(bits: Column | str) -> Column:
    """Of an array of ascending bits: at most 32,768 leaves, so one row holds them all."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: merkle_root_of(v if v is not None else []))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(bits)


def merkle_leaf(bit: Column) -> Column:
    low = F.regexp_replace(F.lpad(F.hex(bit.cast("long")), 8, "0"), "(..)(..)(..)(..)", "00$4$3$2$1")
    return F.sha1(F.unhex(low))


def atom_tree(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys, atoms, root)."""
    sets = bits.groupBy(*keys).agg(F.array_sort(F.collect_set("bit")).alias("atoms"))
    return sets.withColumn("root", merkle_root("atoms"))
