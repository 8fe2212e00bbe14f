"""Grouped summaries of the run log: one pass over the log each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def model_summary(runs: DataFrame) -> DataFrame:
    """Per model: runs, means, outcome rates, excerpt check, cost; best mean score first."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    n = F.count("*")
    cited = F.count_if(F.col("excerpt_verified").isNotNull())
    found = runs.groupBy("model_id").agg(
        n.alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg("honesty_score").alias("mean_honesty"),
        F.avg("logprob_confidence").alias("mean_logprob"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        rate(F.count_if("is_correct"), n).alias("accuracy"),
        rate(count("hallucination"), n).alias("hallucination_rate"),
        rate(count("abstain_miss") + count("correct_abstain"), n).alias("abstention_rate"),
        rate(F.count_if(F.col("error").isNotNull()), n).alias("error_rate"),
        F.try_divide(F.count_if("excerpt_verified"), cited).alias("excerpt_verified_rate"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("co2e_grams").alias("total_co2e_grams"),
        F.max("version").alias("latest_version"),
    )
    return found.orderBy(F.desc_nulls_last("mean_score"), "model_id")


def run_versions(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Per prompt version that was run: runs and distinct models."""
    return runs.join(versions, "version").groupBy("version", "accepted").agg(F.count("*").alias("n_runs"), F.countDistinct("model_id").alias("n_models")).orderBy("version")


def judge_summary(judgments: DataFrame, runs: DataFrame) -> DataFrame:
    """Per model what judges said; a run counts once for each judge."""
    return judgments.join(runs.select("run_id", "model_id"), "run_id").groupBy("model_id").agg(F.count("*").alias("n_judged"), F.avg(F.col("verdict").cast("double")).alias("judged_accuracy"))


def optimizer_stats(iterations: DataFrame) -> DataFrame:
    """Per model candidates, accepted ones, and candidates since the last accepted: its time is joined back, so no model is one task."""
    last = iterations.groupBy(F.col("model_id").alias("_model")).agg(F.max(F.when(F.col("accepted"), F.col("created_at"))).alias("last"))
    since = F.count_if(F.col("last").isNull() | (F.col("created_at") > F.col("last")))
    timed = iterations.join(last, F.col("model_id").eqNullSafe(F.col("_model")))
    return timed.groupBy("model_id").agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"), since.alias("since_accept"))


def improvement(iterations: DataFrame) -> DataFrame:
    """Per model the range of mean scores; no improvement is told where the least is 0 or null."""
    found = iterations.groupBy("model_id").agg(F.min("mean_score").alias("low"), F.max("mean_score").alias("high"), F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))
    return found.withColumn("delta", F.when(F.coalesce(F.col("low"), F.lit(0.0)) == 0, 0.0).otherwise(F.col("high") - F.col("low")))


def error_rates(runs: DataFrame, least: int = 10, above: float = 0.05) -> DataFrame:
    found = runs.groupBy("model_id", "version").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    found = found.withColumn("error_rate", F.col("n_errors") / F.col("n"))
    tier = F.when(F.col("error_rate") > 0.30, "broken").when(F.col("error_rate") > 0.10, "unstable").otherwise("reliable")
    return found.where((F.col("n") >= least) & (F.col("error_rate") > above)).withColumn("reliability", tier)


def costliest(runs: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    found = runs.groupBy(*keys).agg(F.sum("cost_usd").alias("cost_usd"), F.sum("co2e_grams").alias("co2e_grams"), F.count("*").alias("n"))
    found = found.withColumn("cost_per_1k", F.col("cost_usd") / F.col("n") * 1000)
    return found.orderBy(F.desc_nulls_last("cost_usd"), *keys).limit(limit)


def all_failed(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys all of whose runs failed."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("ok")).where("ok = 0").drop("ok")


def complete_cases(truth: DataFrame, n_fields: int) -> DataFrame:
    return truth.groupBy("record_id").agg(F.countDistinct("field_name").alias("n_fields")).where(F.col("n_fields") == n_fields)


def field_summary(rows: DataFrame, by: str, value: str, bar: float) -> DataFrame:
    """Count, passes, range, interpolated median and the lower middle value, which is one of the values."""
    found = rows.groupBy(by).agg(
        F.count(value).alias("n"),
        F.count_if(F.col(value) >= bar).alias("n_pass"),
        F.max(value).alias("high"),
        F.median(value).alias("median"),
        F.min(value).alias("low"),
        (100 * F.count_if(F.col(value) >= bar) / F.count(value)).alias("pass_pct"),
    )
    return ranks.same(found, ranks.lower_middle(rows, [by], value).withColumnRenamed(value, "lower_median"), [by], "left")


def frequencies(rows: DataFrame, value: str, most: int | None = None) -> DataFrame:
    found = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return found if most is None else found.where(F.col("n") <= most)


def imbalance(rows: DataFrame, label: str, above: float = 0.4) -> DataFrame:
    """One row: distinct labels, the commonest (of ties the smallest), its share of all rows, and if that is too much; none without labels."""
    counts = frequencies(rows, label)
    n = rows.agg(F.count("*").alias("n"))  # rows without a label count
    top = counts.agg(F.count("*").alias("n_labels"), F.min(F.struct((-F.col("n")).alias("less"), label)).alias("t")).where("n_labels > 0")
    share = -F.col("t.less") / F.col("n")
    return top.join(F.broadcast(n)).select("n_labels", F.col(f"t.{label}").alias("commonest"), share.alias("share"), (share > above).alias("imbalanced"))


def confused_pairs(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The commonest wrong (truth, predicted) pairs."""
    wrong = rows.where("truth IS NOT NULL AND predicted IS NOT NULL AND truth <> predicted")
    return wrong.groupBy("truth", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "predicted").limit(limit)


def first_values(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Per key the values that aren't blank, in order: all, each once, and the first."""
    there = rows.where(F.trim(F.coalesce(column, F.lit(""))) != "")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column])
    return there.groupBy(key).agg(listed.alias("listed")).select(key, "listed", F.array_distinct("listed").alias("distinct_values"), F.col("listed")[0].alias("first_value"))


def estimated_tokens(texts: DataFrame, text: str) -> DataFrame:
    """Mean, 95th of a hundred by rank (index floor(0.95 n)) and most of length div 4, from counts of each length."""
    counts = texts.select(F.floor(F.length(text) / 4).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("tokens"))
    total = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rank = F.floor(F.col("total") * 95 / 100)
    return total.agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("mean_tokens"), F.min(F.when(F.col("upto") > rank, F.col("tokens"))).alias("p95_tokens"), F.max("tokens").alias("most_tokens"))
