"""Gates, stop rules and the next action, as column expressions over a row of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import T
from . import metrics, summaries, versions
from .tables import durable


def floor_ok(recall: Column | None, sensitivity: Column | None, gateable: Column | None) -> Column:
    """The miss-rate floor that fits the field; none applies without enough rows."""
    if recall is not None:
        return F.coalesce(recall >= T.recall_floor, F.lit(True))
    return F.when(F.coalesce(gateable, F.lit(False)), sensitivity >= T.sensitivity_floor).otherwise(True)


def stop_status(n: Column, since: Column, best: Column, threshold: Column) -> Column:
    """optimize, or why to stop: budget, task_limited, plateaued."""
    stuck = (n >= T.least_iterations) & (since >= T.plateau)
    return F.when(n >= T.iteration_budget, "budget").when(stuck & (threshold - best > T.task_limit_gap), "task_limited").when(stuck, "plateaued").otherwise("optimize")


def stage_status(runs: DataFrame, prompt_versions: DataFrame, judgments: DataFrame, iterations: DataFrame, threshold: float = T.kappa_gate) -> DataFrame:
    """Per model on its best version: metrics, floor, judges, gate and what the optimizer should do. A null metric doesn't pass."""
    key = ["model_id", "version"]
    cells = runs.groupBy(*key, "truth", "predicted").agg(F.count("*").alias("n"), F.min("run_id").alias("seen"))
    cells = durable(cells)  # all that the versions' choice, kappa and the confusion matrix need of the runs
    best = durable(versions.best_of(cells.groupBy(*key).agg(F.sum("n").alias("n_runs")), prompt_versions).select(*key))
    chosen = cells.where("truth IS NOT NULL AND truth <> ''").join(best, key, "left_semi")
    quality = metrics.categorical_of(chosen, ["model_id"])
    judged = summaries.judge_summary(judgments, runs.join(best, key, "left_semi"))
    found = quality.join(judged, "model_id", "left").join(summaries.optimizer_stats(iterations), "model_id", "left")
    bar = F.lit(threshold)
    clears = F.coalesce(F.col("kappa") >= bar, F.lit(False)) & floor_ok(None, F.col("sensitivity"), F.col("sensitivity_gateable"))
    flattered = clears & F.coalesce(F.col("kappa") - F.col("judged_accuracy") > T.judge_margin, F.lit(False))
    passed = clears & ~flattered
    count = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(passed, "passed").otherwise(stop_status(count("n_candidates"), count("since_accept"), F.coalesce("kappa", F.lit(0.0)), bar))
    return found.select(
        "model_id", "n", "accuracy", "kappa", "sensitivity", "specificity", "f2", "n_undersampled", "sensitivity_gateable", "judged_accuracy",
        count("n_judged").alias("n_judged"), passed.alias("gate_passed"), flattered.alias("judge_disagreement"), status.alias("opt_status"),
        count("n_candidates").alias("n_candidates"), count("n_accepted").alias("n_accepted"),
    )


def band(passed: Column, review: Column, metric: Column, gate: Column) -> Column:
    return F.when(review, "review").when(passed, "pass").when(metric >= 0.85 * gate, "near").when(metric >= 0.70 * gate, "improving").otherwise("low")


def next_action(state: DataFrame, final_stage: int = T.stage_records) -> DataFrame:
    """The action for a field's state: refs, unjudged, n_evaluated, n_optimizable, n_flagged, n_below, best_passes."""
    action = (
        F.when(F.col("refs") == 0, "extract")
        .when(F.col("unjudged") > 0, "judge")
        .when(F.col("n_evaluated") == 0, "judge")
        .when(F.col("n_optimizable") > 0, "optimize")
        .when(F.col("best_passes") & (F.col("refs") < final_stage), "extract")
        .when(F.col("best_passes"), "done")
        .when(F.col("n_flagged") > 0, "review")
        .otherwise("stuck")
    )
    return state.withColumn("action", action)


# By how much a candidate has to be better, and for fields whose metric varies more.
EPSILON, FIELD_EPSILON = 0.01, {"authors": 0.03, "author_affiliation": 0.03}


def epsilon(field: Column) -> Column:
    """By how much a candidate for the field has to be better."""
    found = F.lit(EPSILON)
    for name, more in FIELD_EPSILON.items():
        found = F.when(field == name, more).otherwise(found)
    return found


def accepts(candidates: DataFrame, epsilon: Column) -> DataFrame:
    """A candidate is taken if it beats the best by epsilon, keeps its floor, and holds on models that didn't train it."""
    better = F.col("val_score") > F.col("best_score") + epsilon
    return candidates.withColumn("accepted", better & F.col("floor_ok") & F.coalesce(F.col("holdout_score") >= F.col("holdout_best") - epsilon, F.lit(True)))
