"""Latest and best rows by windows and max_by; the choice of prompt versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable


def best_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Per model the highest accepted version that was run, else the version with most runs, the higher of ties."""
    return best_of(runs.groupBy("model_id", "version").agg(F.count("*").alias("n_runs")), versions)


def best_of(counts: DataFrame, versions: DataFrame) -> DataFrame:
    """The same from counts (model_id, version, n_runs)."""
    counts = counts.join(versions, "version")
    order = Window.partitionBy("model_id").orderBy(F.desc("accepted"), F.desc_nulls_last(F.when(F.col("accepted"), F.col("version"))), F.desc("n_runs"), F.desc("version"))
    return counts.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("model_id", "version", "accepted", "n_runs")


def of_best_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """The runs of each model's best version: a semi-join with a written table of a row for each model, whose size Spark knows."""
    return runs.join(durable(best_version(runs, versions).select("model_id", "version")), ["model_id", "version"], "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key the row that comes last in order, by one aggregation without a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(*keys, "last.*")


def next_version(versions: DataFrame, by: list[str]) -> DataFrame:
    return versions.groupBy(*by).agg((F.max("version") + 1).alias("next_version"))


def with_fallback(models: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """Each model's own prompt, else the shared one."""
    return models.join(own.withColumnRenamed("version", "own"), "model_id", "left").crossJoin(F.broadcast(shared.select(F.col("version").alias("shared")))).select("model_id", F.coalesce("own", "shared").alias("version"), F.col("own").isNull().alias("is_shared"))


def progression(scores: DataFrame) -> DataFrame:
    """Per model the score of its first and last version and what lies between."""
    found = scores.groupBy("model_id").agg(F.min_by("score", "version").alias("first_score"), F.max_by("score", "version").alias("last_score"), F.count("*").alias("n_versions"))
    return found.withColumn("delta", F.col("last_score") - F.col("first_score"))


def best_per_group(rows: DataFrame, by: str, metric: str, tie: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(metric), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
