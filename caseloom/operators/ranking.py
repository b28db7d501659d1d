"""Ranks and exact quantiles over all rows, without a window or a task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.graph import cut

#: Ranges that one round of a quantile's search tells apart.
RANGES = 1024


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with 1, 2, ... in the given order, which should leave no ties.

    Rows are range-partitioned by the order and sorted inside; a partition's numbers start after the rows of those before
    it. Only the count of each partition meets in one place.
    """
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The id holds the partition above its 33 low bits and the row's place below.
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, (F.col("_before") + place + 1).cast("long")).drop("_part", "_before", "_at")


def running_sum(rows: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """rows with the sum of a column over all rows before each one in a distinct order: summed inside ranges of the order, each of which starts with the sum of the ranges before it."""
    held = cut(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = held.groupBy("_part").agg(F.sum(column).alias("_t"))
    first = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_before"))
    inside = F.sum(column).over(Window.partitionBy("_part").orderBy(order)) - F.col(column)
    return held.join(F.broadcast(first), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def _value_at(values: DataFrame, rank: int, low: float, high: float) -> tuple[float, int]:
    """The value of a rank (from 0), and how many values reach up to it: a histogram of ranges, then one of the range that holds the rank, until that is one value."""
    before = 0
    while True:
        own = values.where((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / RANGES
        # Of values so close that no range between them has a width, each is a range of its own.
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("v") - low) / width)) if width > 0 and math.isfinite(width) else F.col("v")
        for r in own.groupBy(place.alias("place")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).orderBy("place").collect():
            if rank < before + r["n"]:
                low, high = r["low"], r["high"]
                if low == high:
                    return low, before + r["n"]
                break
            before += r["n"]


def exact_quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The q-quantile of all finite values, interpolated between the two nearest; None without any.

    Each round counts at most RANGES ranges with partial sums, and the next one looks at one of them, so nothing but
    those counts meets in one place, however many different values there are. `rows` is read in every round, so it
    should be a table or a checkpoint.
    """
    v = F.col(column).cast("double")
    values = rows.select(v.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    at = q * (n - 1)
    first, upto = _value_at(values, math.floor(at), low, high)
    if math.ceil(at) < upto:
        return first
    second = values.where(F.col("v") > first).agg(F.min("v")).first()[0]
    return (math.ceil(at) - at) * first + (at - math.floor(at)) * second
