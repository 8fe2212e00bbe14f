"""Reproducible samples and splits: the order is by md5 of the seed and the key, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def minibatches(rows: DataFrame, key: str, seed: int, iterations: int, k: int = 8) -> DataFrame:
    """For each iteration k rows without replacement, or all if there are fewer, in an order of the iteration's own.

    Tasks keep their first k of an iteration before the shuffle.
    """
    each = rows.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("iteration").cast("string"), F.lit(":"), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy("iteration").orderBy(order, key))
    return each.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _placed(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with their rank in the shuffled order and the number of all rows.

    The ranks come from the counts of hash prefixes, so that no window holds all rows.
    """
    hashed = rows.withColumn("_h", shuffled(key, seed)).withColumn("_bucket", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sizes.withColumn("_before", before).withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    return hashed.join(F.broadcast(whole), "_bucket").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)))


def _dealt(placed: DataFrame, part: Column) -> DataFrame:
    return placed.withColumn("part", part).drop("_h", "_bucket", "_n", "_before", "_total", "_rank")


def split(rows: DataFrame, key: str, seed: int, holdout: int, val: int) -> DataFrame:
    """Disjoint parts: holdout at most a third, validation at most half of what is left, the rest trains."""
    h = F.least(F.lit(holdout), F.floor(F.col("_total") / 3))
    v = F.least(F.lit(val), F.greatest(F.lit(1), F.floor((F.col("_total") - h) / 2)))
    rank = F.col("_rank")
    return _dealt(_placed(rows, key, seed), F.when(rank <= h, "holdout").when(rank <= h + v, "val").otherwise("train"))


def split_fractions(rows: DataFrame, key: str, seed: int, test: float, val: float) -> DataFrame:
    """Disjoint parts of the floor of each fraction of all rows; the rest trains."""
    rank, n_test = F.col("_rank"), F.floor(F.col("_total") * test)
    return _dealt(_placed(rows, key, seed), F.when(rank <= n_test, "test").when(rank <= n_test + F.floor(F.col("_total") * val), "val").otherwise("train"))


def split_validation(rows: DataFrame, key: str, seed: int, val: float) -> DataFrame:
    """A fraction for validation, one row at least; none of ten rows or fewer."""
    n_val = F.when(F.col("_total") > 10, F.greatest(F.lit(1), F.floor(F.col("_total") * val))).otherwise(0)
    return _dealt(_placed(rows, key, seed), F.when(F.col("_rank") <= n_val, "val").otherwise("train"))


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """One row of each stratum in turn until there are n."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(key, seed), key))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and has no done row."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
