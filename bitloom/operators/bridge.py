"""Bridges between lattices by rank correlation of 3-gram fingerprints, and routing by inclusion.

The 3-grams of a set run over its bits in order, so one row holds a set's bits (32,768 at most) and no window over a
whole table is needed; the 1,024 register counts of a fingerprint are compared row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.consts import EOS, M
from bitloom.functions.hashing import murmur3, positions, token_bits
from bitloom.operators import algebra, sketch

START, END = "_START_", "_END_"


def represented_tokens(bits: Column) -> Column:
    """A token for each bit: reg:{r}:tz:{t}."""
    return F.transform(bits, lambda b: F.concat(F.lit("reg:"), F.shiftright(b, 5).cast("string"), F.lit(":tz:"), b.bitwiseAND(31).cast("string")))


def re_represent(bits: Column) -> Column:
    """The bits of the sketch of a set's own bits, written as tokens."""
    return token_bits(represented_tokens(bits))


def trigrams_of(words: list[bytes]) -> list[bytes]:
    """3-grams of padded words; none of none."""
    padded = [START.encode(), *words, END.encode()]
    return [b"\0".join(padded[i : i + 3]) for i in range(len(padded) - 2)]


def trigram_bits_of(bits: np.ndarray) -> np.ndarray:
    """Bits of the 3-grams of bits in order, each written {register}:{level}."""
    return np.unique(positions(murmur3(trigrams_of([b"%d:%d" % (b >> 5, b & 31) for b in bits]))))


def trigram_bits(bits: Column | str) -> Column:
    """trigram_bits_of() a column of arrays of bits."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([trigram_bits_of(np.asarray(v if v is not None else [], np.int64)).astype(np.int32) for v in values], index=values.index)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(bits)


def register_vector(bits: Column | str) -> Column:
    """How many bits of each of the 1,024 registers are in an array of bits."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(v if v is not None else [], np.int64) >> 5, minlength=M).astype(np.int32) for v in values], index=values.index)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(bits)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from the greatest down, equal values share their mean rank."""
    values, inverse, counts = np.unique(-x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[inverse]


def spearman_of(a, b) -> float:
    n = min(len(a), len(b))
    a, b = np.asarray(a[:n], float), np.asarray(b[:n], float)
    if n < 2:
        return 1.0 if n == 1 and a[0] == b[0] else 0.0
    x, y = average_ranks(a), average_ranks(b)
    x, y = x - x.mean(), y - y.mean()
    vx, vy = (x * x).sum(), (y * y).sum()
    return float((x * y).sum() / (vx**0.5 * vy**0.5)) if vx and vy else 0.0


def spearman(a: Column | str, b: Column | str) -> Column:
    """Rank correlation of two arrays of numbers, cut to the shorter one."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([spearman_of(p, q) for p, q in zip(x, y)], index=x.index)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def represented_of(bits: np.ndarray) -> np.ndarray:
    return np.unique(positions(murmur3([b"reg:%d:tz:%d" % (b >> 5, b & 31) for b in bits])))


def fingerprint_of(bits: np.ndarray, times: int = 1) -> np.ndarray:
    """The 1,024 register counts of a set's 3-grams, the set re-represented so many times before."""
    for _ in range(times):
        bits = represented_of(bits)
    return np.bincount(trigram_bits_of(bits) >> 5, minlength=M).astype(np.int32)


def fingerprints(sets: DataFrame, *keys: str, again: bool = False) -> DataFrame:
    """(keys, vector) of sets (keys, bits), which are re-represented first; again: of the sets re-represented before that.

    One Arrow function does all steps of a set: its bits are in its row."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(np.asarray(v if v is not None else [], np.int64), 1 + again) for v in values], index=values.index)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return sets.select(*keys, F.pandas_udf(run, "array<int>")("bits").alias("vector"))


def bridge(source: DataFrame, candidates: DataFrame, k: int, key: str = "key") -> DataFrame:
    """(key, rho): the k candidates (key, bits) that correlate best with the one re-represented source (bits). Ties: by key."""
    one = fingerprints(source.limit(1), again=True).select(F.col("vector").alias("source"))
    scored = fingerprints(candidates, key).join(F.broadcast(one)).select(key, spearman("source", "vector").alias("rho"))
    return scored.orderBy(F.desc("rho"), key).limit(k)


# --- routing -------------------------------------------------------------------------------------------------------


def node_fingerprints(sets: DataFrame, node: str = "node") -> DataFrame:
    """(node, bm, set_count). Taking a set away later lowers the count only: bits go with a rebuild from the sets."""
    return sets.groupBy(node).agg(F.bitmap_or_agg("bm").alias("bm"), F.count("*").alias("set_count"))


def route(nodes: DataFrame, request: DataFrame, k: int, node: str = "node") -> DataFrame:
    """(node, tau): the k nodes that include most of the one request (bm). Nodes that share nothing are left out; ties: by name."""
    pairs = nodes.select(node, F.col("bm").alias("bm_a")).join(F.broadcast(request.limit(1).select(F.col("bm").alias("bm_b"))))
    return algebra.measured(pairs).filter("tau > 0").select(node, "tau").orderBy(F.desc("tau"), node).limit(k)


def novelty(nodes: DataFrame, request: DataFrame, node: str = "node") -> DataFrame:
    """(node, rho) of all nodes: what each has beyond the one request (bm), against the request's estimate."""
    pairs = nodes.select(node, F.col("bm").alias("bm_a")).join(F.broadcast(request.limit(1).select(F.col("bm").alias("bm_b"))))
    return algebra.measured(pairs).select(node, "rho")


def coverage(responses: DataFrame, request: DataFrame) -> DataFrame:
    """(responses, coverage): what the OR of the partial responses (bm) has of the one request's (bm) estimate; 1 of nothing."""
    merged = responses.agg(F.count("bm").alias("responses"), F.bitmap_or_agg("bm").alias("bm"))
    both = merged.join(F.broadcast(request.limit(1).select(sketch.card("bm").alias("asked"))))
    share = F.when(F.col("asked") == 0, F.lit(1.0)).otherwise(F.try_divide(sketch.card("bm"), F.col("asked")))
    return both.select("responses", share.alias("coverage"))


class Router:
    """A table of nodes (node, bm, set_count) under the names of a registry; every change gives a new table."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def add_node(self, node: DataFrame) -> Router:
        """Adds a row, or puts it in the place of the one of its name."""
        return Router(self.nodes.join(node.select("node"), "node", "left_anti").unionByName(node))

    update_node = add_node

    def remove_node(self, name: str) -> Router:
        return Router(self.nodes.filter(F.col("node") != name))

    def add_set(self, name: str, bm: DataFrame) -> Router:
        """ORs one sketch (bm) into a node and counts it."""
        one = bm.limit(1).select(F.col("bm").alias("more"))
        named = self.nodes.filter(F.col("node") == name).join(F.broadcast(one))
        return self.add_node(named.select("node", sketch.combined("bm", "more", "union").alias("bm"), (F.col("set_count") + 1).alias("set_count")))

    def remove_set(self, name: str) -> Router:
        """Counts one sketch less; its bits stay until the node is rebuilt from its sets."""
        less = F.when(F.col("node") == name, F.greatest(F.col("set_count") - 1, F.lit(0))).otherwise(F.col("set_count"))
        return Router(self.nodes.withColumn("set_count", less.cast("long")))

    def rank(self, request: DataFrame, k: int) -> DataFrame:
        return route(self.nodes, request, k)

    def __len__(self) -> int:
        return self.nodes.count()

    def is_empty(self) -> bool:
        return self.nodes.isEmpty()
