"""Sketches over time: the pyramid of layers, links between states, ranks and their change, steering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.operators import algebra, sketch

#: Commits after which each layer's content moves up: the default pyramid, L0 to L6.
LAYERS = (1, 60, 3600, 86400, 604800, 2629800, 31557600)


def layer_of(commit: Column, now: Column, sizes: tuple[int, ...] = LAYERS) -> Column:
    """The layer that holds a commit (numbered from 1) when there are ``now`` of them.

    At every multiple of a layer's size all that lies below it moves up into it, so a commit is in the highest layer that
    had a boundary since. The layer is a function of two numbers: no state is carried from commit to commit.
    """
    out = F.lit(0)
    for size in sizes[1:]:
        out = out + (commit <= F.floor(now / size) * size).cast("int")
    return out.cast("long")


def pyramid(commits: DataFrame, now: int | Column, *keys: str, sizes: tuple[int, ...] = LAYERS) -> DataFrame:
    """(keys, layer, bm) of commits (keys, commit, bm)."""
    now = F.lit(now) if isinstance(now, int) else now
    return commits.withColumn("layer", layer_of(F.col("commit"), now, sizes)).groupBy(*keys, "layer").agg(F.bitmap_or_agg("bm").alias("bm"))


def rlinks(pairs: DataFrame, theta: int = 0) -> DataFrame:
    """Pairs (.., bm_a, bm_b) that share more than theta bits, and how many."""
    rest = [c for c in pairs.columns if c not in ("bm_a", "bm_b")]
    shared = sketch.popcount(sketch.combined("bm_a", "bm_b", "intersection"))
    return pairs.select(*rest, shared.alias("weight")).filter(F.col("weight") > theta)


def time_lens(bits: DataFrame, tf: DataFrame) -> DataFrame:
    """The bits' frequencies of one version of tf (bit, tf)."""
    return bits.join(tf, "bit")


def rank_vector(bits: DataFrame, tf: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank, mean_rank): frequencies summed over each set's bits, and their mean over the bits."""
    joined = bits.join(tf, "bit", "left").groupBy(*keys).agg(F.sum(F.coalesce("tf", F.lit(0.0))).alias("rank"), F.count("*").alias("n"))
    return joined.select(*keys, "rank", F.try_divide("rank", "n").alias("mean_rank"))


def observable(ranks: DataFrame, theta: float) -> DataFrame:
    """The bits of rank (bit, rank) above theta."""
    return ranks.filter(F.col("rank") > theta).select("bit")


def rank_flux(ranks: DataFrame, step: str, *keys: str) -> DataFrame:
    """(keys, step, rank, delta, accel): the first and second difference of ranks (keys, step, rank)."""
    w = W.partitionBy(*keys).orderBy(step)
    out = ranks.withColumn("delta", F.col("rank") - F.lag("rank").over(w))
    return out.withColumn("accel", F.col("delta") - F.lag("delta").over(w))


def steering(parts: DataFrame, step: str) -> DataFrame:
    """(step, gained, lost, v, a) of (step, part, bit): estimates of what came and went, their difference, and its change."""
    sets = parts.filter("part <> 'R'").groupBy(step, "part").agg(F.bitmap_construct_agg("bit").alias("bm"))
    cards = sets.select(step, "part", sketch.card("bm").alias("card")).groupBy(step)
    wide = cards.agg(*(F.coalesce(F.max(F.when(F.col("part") == p, F.col("card"))), F.lit(0.0)).alias(n) for p, n in (("N", "gained"), ("D", "lost"))))
    v = wide.withColumn("v", F.col("gained") - F.col("lost"))
    return v.withColumn("a", F.col("v") - F.lag("v").over(W.orderBy(step)))


def flux(rows: DataFrame, step: str) -> DataFrame:
    """(step, drift, influx, outflux, v, a, mass, force) of ranks (step, bit, rank) at whole-numbered steps.

    drift: how the ranks of the bits that stay change; influx and outflux: the ranks of those that come and those that went;
    v: influx without outflux; a: its change; mass: the rank of the whole state; force: mass times a."""
    w = W.partitionBy("bit").orderBy(step)
    before, after = F.lag(F.struct(step, "rank")).over(w), F.lead(step).over(w)
    seen = rows.withColumn("p", before).withColumn("n", after)
    stays, none = F.col(f"p.{step}") == F.col(step) - 1, F.lit(0).cast("long")
    stays = F.coalesce(stays, F.lit(False))
    now = seen.select(step, F.when(stays, F.col("rank") - F.col("p.rank")).otherwise(none).alias("drift"), F.when(stays, none).otherwise(F.col("rank")).alias("influx"), none.alias("outflux"), F.col("rank").alias("mass"))
    gone = seen.filter(~F.col("n").eqNullSafe(F.col(step) + 1)).select((F.col(step) + 1).alias(step), none.alias("drift"), none.alias("influx"), F.col("rank").alias("outflux"), none.alias("mass"))
    out = now.unionByName(gone).groupBy(step).agg(*(F.sum(c).alias(c) for c in ("drift", "influx", "outflux", "mass")))
    out = out.withColumn("v", F.col("influx") - F.col("outflux"))
    out = out.withColumn("a", F.col("v") - F.lag("v").over(W.orderBy(step)))  # one row a step
    return out.select(step, "drift", "influx", "outflux", "v", "a", "mass", (F.col("mass") * F.col("a")).alias("force"))


def running(sets: DataFrame, step: str, last: int, *keys: str) -> DataFrame:
    """(keys, step, bm): at each row of (keys, step, bm) the OR of it and the last - 1 rows before it."""
    w = W.partitionBy(*keys).orderBy(step).rowsBetween(1 - last, 0)
    return sets.select(*keys, step, F.bitmap_or_agg("bm").over(w).alias("bm"))


def step_parts(rows: DataFrame, step: str) -> DataFrame:
    """(step, bit, part): what departed, stayed and came at each whole-numbered step of (step, bit)."""
    w = W.partitionBy("bit").orderBy(step)
    seen = rows.select(step, "bit").distinct().withColumn("p", F.lag(step).over(w)).withColumn("n", F.lead(step).over(w))
    now = seen.select(step, "bit", F.when(F.col("p") == F.col(step) - 1, "R").otherwise("N").alias("part"))
    gone = seen.filter(~F.col("n").eqNullSafe(F.col(step) + 1))
    return now.unionByName(gone.select((F.col(step) + 1).alias(step), "bit", F.lit("D").alias("part")))


def controller(tau_01: Column, tau_03: Column) -> Column:
    """What the inclusion of the youngest layer in the next and in the fourth calls for."""
    return F.when(tau_01 < 0.5, "override").when(tau_03 < 0.3, "re-route").otherwise("stable")


def control(layers: DataFrame, *keys: str) -> DataFrame:
    """(keys, tau_01, tau_03, action) of layers (keys, layer, bm); a layer that isn't there is empty."""
    of = lambda k: F.coalesce(F.max(F.when(F.col("layer") == k, F.col("bm"))), sketch.empty()).alias(f"l{k}")
    wide = layers.groupBy(*keys).agg(of(0), of(1), of(3))
    one = algebra.measured(wide.select(*keys, "l0", "l1"), "l0", "l1").select(*keys, F.col("tau").alias("tau_01"))
    three = algebra.measured(wide.select(*keys, "l0", "l3"), "l0", "l3").select(*keys, F.col("tau").alias("tau_03"))
    both = one.join(three, list(keys)) if keys else one.crossJoin(three)  # one row each without keys
    return both.withColumn("action", controller(F.col("tau_01"), F.col("tau_03")))


def cooccurrence(layers: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b, n): in how many layers (layer, bit) two of the asked-for bits (bit) stand together."""
    own = layers.join(bits.select("bit"), "bit", "left_semi").select("layer", "bit").distinct()
    pairs = own.select("layer", F.col("bit").alias("a")).join(own.select("layer", F.col("bit").alias("b")), "layer").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def channel_inclusion(measured: DataFrame, *keys: str) -> DataFrame:
    """(keys, tau, rho) over channels of disjoint n-gram sketches, of measured rows (keys, .., card_b, tau, rho): each channel
    weighs as much as its part of B's estimate."""
    total = measured.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col("card_b") * F.col(c)), F.sum("card_b")).alias(c) for c in ("tau", "rho")))
    return total.select(*keys, F.coalesce("tau", F.lit(1.0)).alias("tau"), F.coalesce("rho", F.lit(0.0)).alias("rho"))
