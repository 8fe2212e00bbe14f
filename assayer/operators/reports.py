"""Reports over gated models, judges and prompt candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import T
from ..functions import parsing
from . import metrics

BOLD_AFTER, STOP_AFTER, ATTEMPTS = 2, 4, 3


def verdict(raw: Column) -> Column:
    """A judge's reply as 1 or 0 by what its `correct` holds; null where the reply can't be read or doesn't say."""
    said = F.try_variant_get(parsing.json_object(raw), "$.correct", "variant")
    kind, text = F.schema_of_variant(said), F.try_variant_get(said, "$", "string")
    no = F.when(kind == "BOOLEAN", text == "false").when(kind == "VOID", F.lit(True)).when(kind == "STRING", text == "").otherwise(F.coalesce(text.try_cast("double") == 0, F.lit(False)) | text.isin("[]", "{}"))
    return F.when(said.isNotNull(), F.when(no, 0.0).otherwise(1.0))


def judge_mean(replies: DataFrame, by: str, raw: str) -> DataFrame:
    """Mean verdict and how many replies could be read; 0 and 0 if none could."""
    return replies.groupBy(by).agg(F.coalesce(F.avg(verdict(F.col(raw))), F.lit(0.0)).alias("mean_verdict"), F.count(verdict(F.col(raw))).alias("n"))


def gate_report(rows: DataFrame, by: list[str], least: int = 5, gate: float = T.gate) -> DataFrame:
    """Per group the accuracy of the answers and whether it passes; groups under the least number of rows are left out."""
    found = metrics.kappa(rows.where("predicted IS NOT NULL"), by)
    return found.where(F.col("n") >= least).withColumn("passes", F.col("accuracy") >= gate)


def gate_summary(report: DataFrame, by: str) -> DataFrame:
    """Per field how many models pass, and the best, worst and upper middle metric."""
    ordered = F.sort_array(F.collect_list("accuracy"), asc=False)
    found = report.groupBy(by).agg(F.count_if("passes").alias("n_passing"), F.count("*").alias("n_models"), F.max("accuracy").alias("best"), F.min("accuracy").alias("worst"), F.avg("accuracy").alias("mean"), ordered.alias("o"))
    return found.withColumn("median", F.col("o")[F.floor(F.size("o") / 2).cast("int")]).drop("o")


def passing_share(report: DataFrame) -> DataFrame:
    share = F.coalesce(F.floor(F.try_divide(F.count_if("passes"), F.count("*")) * 100 + 0.5), F.lit(0))
    return report.agg(F.count_if("passes").alias("n_passing"), F.count("*").alias("n_pairs"), share.alias("overall_pct"))


def compared_models(runs: DataFrame, gate: float = T.gate) -> DataFrame:
    """Per model gate metric, kappa, cost and footprint for each answer, and errors: for distilled models beside the others."""
    spent = runs.groupBy("model_id").agg(F.sum("cost_usd").alias("cost"), F.sum("co2e_grams").alias("co2e"), F.count("error").alias("n_errors"), F.count("predicted").alias("n_answers"))
    found = spent.join(gate_report(runs, ["model_id"], 1, gate), "model_id")
    n = F.greatest(F.col("n_answers"), F.lit(1))
    return found.select("model_id", "accuracy", "kappa", "passes", (F.col("cost") / n).alias("cost_per_record"), (F.col("co2e") / n).alias("co2e_per_record"), "n_errors")


def reweighted(sample: DataFrame, population: DataFrame, by: str) -> DataFrame:
    """Accuracy on a sample enriched in some classes, each class weighted by its share of the population."""
    share = population.groupBy("truth").agg(F.count("*").alias("weight"))
    each = sample.groupBy(by, "truth").agg(F.avg(F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).cast("double")).alias("accuracy"))
    return each.join(share, "truth").groupBy(by).agg((F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight")).alias("accuracy"))


def evaluated(responses: DataFrame, by: list[str]) -> DataFrame:
    """A prompt's mean honesty over a record set: failed calls and replies count as 0 and as failures, and give no pair."""
    ok = F.col("error").isNull()
    right = F.count_if(ok & F.col("is_correct"))
    honest = F.avg(F.when(ok, F.coalesce("honesty_score", F.lit(0.0))).otherwise(0.0))
    return responses.groupBy(*by).agg(honest.alias("mean_score"), F.count("*").alias("n"), F.count_if(ok).alias("n_pairs"), right.alias("n_successes"), (F.count("*") - right).alias("n_failures"))


def best_candidates(candidates: DataFrame, run: list[str], step: str, tie: str) -> DataFrame:
    """Per step the candidate with the best mean score, the first of ties. improves says if it was accepted."""
    first = F.max_by(F.struct(F.col(tie), "mean_score", "improves"), F.struct("mean_score", -F.col(tie)))
    return candidates.groupBy(*run, step).agg(first.alias("b")).select(*run, step, "b.*")


def with_all_steps(best: DataFrame, steps: DataFrame, run: list[str], step: str) -> DataFrame:
    """The steps that were taken with their best candidates: a step without any is a miss."""
    return steps.select(*run, step).distinct().join(best, [*run, step], "left").withColumn("improves", F.coalesce("improves", F.lit(False)))


def replayed(steps: DataFrame, run: list[str], step: str) -> DataFrame:
    """The steps of an optimizer's runs up to the stop: rejections in a row before each, and whether it is a bold one.

    A run has at most the iteration budget's steps, so its window is small whatever the number of runs.
    """
    order = Window.partitionBy(*run).orderBy(step)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = steps.withColumn("at", F.row_number().over(order))
    at = at.withColumn("misses", F.col("at") - 1 - F.coalesce(F.max(F.when(F.col("improves"), F.col("at"))).over(before), F.lit(0)))
    at = at.withColumn("stops", ~F.col("improves") & (F.col("misses") + 1 >= STOP_AFTER))
    at = at.withColumn("over", F.coalesce(F.max("stops").over(before), F.lit(False)))
    return at.where("NOT over").withColumn("bold", F.col("misses") >= BOLD_AFTER).drop("at", "over")


def proposals(replies: DataFrame, key: list[str], name: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Per key the first reply, by reflector and attempt, whose JSON holds text under name; later attempts don't count."""
    text = F.trim(F.try_variant_get(parsing.json_object(F.col("raw")), f"$.{name}", "string"))
    told = replies.where(F.col("attempt") <= attempts).withColumn("revised", text).where("revised <> ''")
    return told.groupBy(*key).agg(F.min_by(F.struct("revised", "reflector", "attempt"), F.struct("reflector", "attempt")).alias("p")).select(*key, "p.*")
