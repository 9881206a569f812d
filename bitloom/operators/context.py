"""Contexts (OR of generators), what departs, stays and comes between two states, and follow matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def state(generators: DataFrame, *keys: str) -> DataFrame:
    """(keys, bm) of generators (keys, bm)."""
    return generators.groupBy(*keys).agg(F.bitmap_or_agg("bm").alias("bm"))


def with_generator(generators: DataFrame, more: DataFrame) -> DataFrame:
    return generators.unionByName(more, allowMissingColumns=True)


def without_generator(generators: DataFrame, gone: DataFrame) -> DataFrame:
    """All generators but every one whose bits are those of a row of gone."""
    return generators.join(gone.select("bm").distinct(), "bm", "left_anti").select(*generators.columns)


def evolve(previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """(keys, bit, part) of two tables (keys, bit): D departed, R retained, N novel."""
    on = [*keys, "bit"]
    a, b = previous.select(*on, F.lit(1).alias("was")), current.select(*on, F.lit(1).alias("is"))
    part = F.when(F.col("was").isNull(), "N").when(F.col("is").isNull(), "D").otherwise("R")
    return a.join(b, on, "full_outer").select(*on, part.alias("part"))


def evolve_steps(rows: DataFrame, step: str, *keys: str) -> DataFrame:
    """(keys, step, departed, retained, novel) counts of bits (keys, step, bit) from each whole-numbered step to the next.

    A step that stands alone ends one state and begins another: one shuffle on the bit serves all steps.
    """
    w = W.partitionBy(*keys, "bit").orderBy(step)
    seen = rows.select(*keys, step, "bit").distinct()
    seen = seen.withColumn("before", F.lag(step).over(w) == F.col(step) - 1).withColumn("after", F.lead(step).over(w) == F.col(step) + 1)
    came = seen.select(*keys, F.col(step), F.coalesce("before", F.lit(False)).alias("kept"), F.lit(False).alias("gone"))
    left = seen.filter(~F.coalesce("after", F.lit(False))).select(*keys, (F.col(step) + 1).alias(step), F.lit(False).alias("kept"), F.lit(True).alias("gone"))
    both = came.unionByName(left).groupBy(*keys, step)
    return both.agg(F.count_if("gone").alias("departed"), F.count_if("kept").alias("retained"), F.count_if(~F.col("kept") & ~F.col("gone")).alias("novel"))


def invariants(parts: DataFrame, previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """(keys, holds): D and R make up the previous state, R and N the current one, D and N share nothing."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count_distinct("bit").alias(name))
    p = parts.groupBy(*keys, "bit").agg(F.count("*").alias("times"), F.first("part").alias("part"))
    p = p.groupBy(*keys).agg(
        F.count_if(F.col("part").isin("D", "R")).alias("dr"), F.count_if(F.col("part").isin("R", "N")).alias("rn"), F.max("times").alias("times")
    )
    joined = p.join(count(previous, "was"), list(keys), "left").join(count(current, "is"), list(keys), "left") if keys else p.crossJoin(count(previous, "was")).crossJoin(count(current, "is"))
    same = (F.col("dr") == F.coalesce("was", F.lit(0))) & (F.col("rn") == F.coalesce("is", F.lit(0))) & (F.col("times") == 1)
    return joined.select(*keys, same.alias("holds"))


def follow(pairs: DataFrame) -> DataFrame:
    """(src, dst, w): the greatest weight seen of each cell."""
    return pairs.groupBy("src", "dst").agg(F.max("w").alias("w"))


def follow_merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return follow(out)


def follow_get(table: DataFrame, src: str, dst: str) -> DataFrame:
    """One row: w of a cell, 0 if it is missing."""
    return table.filter((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.max("w"), F.lit(0)).alias("w"))


def follow_restrict(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """The cells with both ends among tokens."""
    return table.join(tokens.select(F.col("token").alias("src")), "src", "left_semi").join(tokens.select(F.col("token").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def transitions(events: DataFrame, who: str, order: list[str], what: str) -> DataFrame:
    """(src, dst, w): how often what follows what, one after the other, for each who."""
    pairs = events.select(F.col(what).alias("src"), F.lead(what).over(W.partitionBy(who).orderBy(*order)).alias("dst"))
    return pairs.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("w"))
