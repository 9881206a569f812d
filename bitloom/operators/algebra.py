"""Set algebra and similarity of sketches.

Unions are bitmap aggregations. Pairs are compared packed: a row of a pair carries 8 KiB, and one pass over it counts
what all measures need (the counts of a union or a difference follow from those of the two and of what they share).
Which pairs are compared is always the caller's table; nothing here joins all sketches with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators import sketch


def union_all(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, bm): OR over each group; of no rows, the empty sketch."""
    return sets.groupBy(*keys).agg(F.bitmap_or_agg("bm").alias("bm"))


def intersection_all(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, bm): AND over each group. Spark's aggregate of no rows has all bits set; here it has none."""
    out = F.when(F.count("bm") > 0, F.bitmap_and_agg("bm")).otherwise(sketch.empty())
    return sets.groupBy(*keys).agg(out.alias("bm"))


def measured(pairs: DataFrame, a: str = "bm_a", b: str = "bm_b") -> DataFrame:
    """pairs without its two sketches, with the measures of A to B:

    card_a, card_b, card_and, card_or, card_diff (A without B), card_rest (B without A), jaccard, tau (inclusion: the share of B in A), rho
    (exclusion: A without B against B), subset (A's bits are all in B) and superset.
    """
    rest = [c for c in pairs.columns if c not in (a, b)]
    counted = pairs.select(*rest, sketch.pair_counts(a, b).alias("_n"))
    level = lambda k: F.slice("_n", 32 * k + 1, 32)
    counted = counted.select(*rest, level(0).alias("_a"), level(1).alias("_b"), level(2).alias("_i"))
    both = lambda f: F.transform(F.arrays_zip("_a", "_b", "_i"), lambda z: f(z["_a"], z["_b"], z["_i"]))
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    cards = counted.select(
        *rest,
        sketch.cardinality(F.col("_a")).alias("card_a"),
        sketch.cardinality(F.col("_b")).alias("card_b"),
        sketch.cardinality(F.col("_i")).alias("card_and"),
        sketch.cardinality(both(lambda x, y, i: x + y - i)).alias("card_or"),
        sketch.cardinality(both(lambda x, y, i: x - i)).alias("card_diff"),
        sketch.cardinality(both(lambda x, y, i: y - i)).alias("card_rest"),
        (total(F.col("_a")) == total(F.col("_i"))).alias("subset"),
        (total(F.col("_b")) == total(F.col("_i"))).alias("superset"),
    )
    ratio = lambda x, y, none: F.when(F.col(y) == 0, F.lit(none)).otherwise(F.try_divide(F.col(x), F.col(y)))
    return cards.select(
        "*",
        ratio("card_and", "card_or", 1.0).alias("jaccard"),
        F.least(ratio("card_and", "card_b", 1.0), F.lit(1.0)).alias("tau"),
        F.least(ratio("card_diff", "card_b", 0.0), F.lit(1.0)).alias("rho"),
    )


def morphism(tau_min: float, rho_max: float) -> Column:
    """Whether measured() rows hold as a morphism at these bounds."""
    return (F.col("tau") >= tau_min) & (F.col("rho") <= rho_max)


def composed(tau_1: Column, rho_1: Column, tau_2: Column, rho_2: Column) -> Column:
    """(tau, rho) of two morphisms in a row: the weakest link."""
    return F.struct(F.least(tau_1, tau_2).alias("tau"), F.greatest(rho_1, rho_2).alias("rho"))


def approx_equal(tau: float) -> Column:
    """Whether measured() rows are morphisms both ways, with no exclusion."""
    back = F.when(F.col("card_a") == 0, F.lit(1.0)).otherwise(F.least(F.try_divide("card_and", "card_a"), F.lit(1.0)))
    back_rho = F.when(F.col("card_a") == 0, F.lit(0.0)).otherwise(F.try_divide("card_rest", "card_a"))
    return morphism(tau, 0.0) & (back >= tau) & (back_rho <= 0.0)


# --- over rows (set_id, bit) ---------------------------------------------------------------------------------------


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def difference_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def symmetric_difference_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return difference_rows(a, b, on).unionByName(difference_rows(b, a, on))
