"""Joins in time: the last row before each row, and the intervals around each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, time: str, *keys: str, value: str) -> DataFrame:
    """left with the value of the last row of right (keys, time, value) at or before each row's time, null where there is
    none; of rows at one time the greatest value. One window over the union of both: no row meets another."""
    rows = left.withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    seen = right.select(*keys, time, F.col(value).alias("_value")).filter("_value is not null").withColumn("_left", F.lit(False))
    w = W.partitionBy(*keys).orderBy(F.col(time), F.col("_left"), F.col("_value")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(seen, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return both.filter("_left").drop("_left", "_value")


def within(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, *keys: str) -> DataFrame:
    """Pairs of a point and each half-open interval [start, end) of its keys that holds it. Both meet on cells of a width: an
    equi-join, where a plain condition would compare all with all."""
    cell = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    cells = intervals.filter(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    both = points.withColumn("_cell", cell(at)).join(cells, [*keys, "_cell"]).drop("_cell")
    return both.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
