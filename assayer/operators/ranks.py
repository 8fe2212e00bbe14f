"""Prefix sums and order statistics of whole groups without a task that holds a group.

Points are dealt in ranges of (group, value) of equal size, which split a large group and join small ones. A range's
sums, a row for each range and group, are added up along the ranges; within a range a window adds up its own points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; right's keys go."""
    if not keys:
        return left.join(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    met: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])
    return left.join(named, met, how).drop(*[f"_{k}_" for k in keys])


def running(points: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """points, one a group and value of order, with upto_<c>, the sum of c up to the point, and whole_<c>, that of its group."""
    key = F.desc(order) if descending else F.asc(order)
    dealt = durable(points.repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    ranges = Window.partitionBy(*by)
    before = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns], *[F.sum(f"_sum_{c}").over(ranges).alias(f"whole_{c}") for c in columns])
    within = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[F.sum(c).over(within).alias(f"_own_{c}") for c in columns])
    found = same(own, ahead, [*by, "_range"])
    return found.select(*points.columns, *[(F.col(f"_own_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in columns], *[f"whole_{c}" for c in columns])


def ranked_value(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """Per group of ranks (by, rank, from 1 upwards) the value with that rank among the group's values; null ones don't count."""
    points = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = same(running(points, by, value, ["_n"]), ranks, by)
    at = (F.col("upto__n") >= F.col("rank")) & (F.col("upto__n") - F.col("_n") < F.col("rank"))
    return placed.where(at).select(*by, value)


def lower_middle(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the value at the middle, the lower of two."""
    middle = rows.groupBy(*by).agg(F.floor((F.count(value) + 1) / 2).alias("rank"))
    return ranked_value(rows, by, value, middle)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their number from 0 in the order in which they are read: positions in partitions, and the partitions' sizes before."""
    held = durable(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_id") % (1 << 33)).alias(name))
