"""Connected components of a table of links, by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import remove, written


def _least(pairs: DataFrame) -> DataFrame:
    """Each u with the least of its neighbours v and itself; aggregated before the shuffle, so hubs do no harm."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both(edges).join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)  # of those at or below it, few have many: hubs are the least ones by now
    links = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (u, v): the least id that it reaches. Loops and repeats do no harm."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _digest(edges)
    while before[0]:
        least = written(_least(_both(edges)), "least")  # so that the join has plain exchanges on both sides and Spark can split a hub
        after = written(_small(_large(edges, least)), "links")
        remove(least)
        remove(edges)
        edges, now = after, _digest(after)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
