"""Gates by the field's kind of value, from one table of answers with their truths, and the state of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Z95_SHORT, T
from . import gates, metrics, ranks

KINDS = ("single_categorical", "list_categorical", "list_text")
#: Fields that are gated on kappa, by a bar of their own.
KAPPA_FIELDS = {"sector_name": T.kappa_gate}
NUMBERS = {"n": "bigint", "accuracy": "double", "kappa": "double", "sensitivity": "double", "sensitivity_gateable": "boolean", "n_undersampled": "bigint", "precision": "double", "recall": "double", "f1": "double"}


def bar(field: Column) -> Column:
    """The metric that a field's models have to reach."""
    found = F.lit(T.gate)
    for name, least in KAPPA_FIELDS.items():
        found = F.when(field == name, least).otherwise(found)
    return found


def gate_metrics(rows: DataFrame, kinds: dict[str, str], by: list[str], order: str = "run_id", universes: dict[str, int] | None = None) -> DataFrame:
    """rows (field_name, by, order, predicted, truth: lists) -> per field and group its metric, what it is made of, floor and gate.

    Single values: kappa where the field is gated on it, else accuracy; the floor is macro sensitivity, once each class
    has support. Lists: micro F1, by names for authors and nearly for text; the floor is recall. Answers that are null
    are the caller's to leave out or in; a group's metric is null where it can't be computed, and then doesn't pass.
    """
    unknown = {k for k in kinds.values() if k not in KINDS}
    if unknown:
        raise ValueError(f"unknown kinds of value: {sorted(unknown)}")
    keys, parts = ["field_name", *by], []
    single = [f for f, k in kinds.items() if k == "single_categorical"]
    if single:
        each = rows.where(F.col("field_name").isin(single)).withColumns({c: F.get(c, F.lit(0)) for c in ("predicted", "truth")})
        parts.append(metrics.categorical(each, keys, order))
    for field, kind in kinds.items():
        if kind != "single_categorical":
            own = rows.where(F.col("field_name") == field)
            parts.append(metrics.list_metrics(own, keys, (universes or {}).get(field), field, kind == "list_text"))
    found = None
    for part in parts:
        part = part.select(*keys, *[(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in NUMBERS.items()])
        found = part if found is None else found.unionByName(part)
    is_list = F.col("f1").isNotNull()
    name = F.when(is_list, "f1").when(F.col("field_name").isin(list(KAPPA_FIELDS)), "kappa").otherwise("accuracy")
    metric = F.when(is_list, F.col("f1")).when(name == "kappa", F.col("kappa")).otherwise(F.col("accuracy"))
    floor = F.when(is_list, gates.floor_ok(F.col("recall"), None, None)).otherwise(gates.floor_ok(None, F.col("sensitivity"), F.col("sensitivity_gateable")))
    found = found.withColumn("metric_name", name).withColumn("metric", metric).withColumn("floor_ok", floor)
    return found.withColumn("passes", F.coalesce(F.col("metric") >= bar(F.col("field_name")), F.lit(False)) & F.col("floor_ok"))


def current_versions(prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Per (field_name, model_id) of models the version in force: its own highest accepted, else the shared highest accepted, if any."""
    accepted = prompts.where("accepted")
    own = accepted.where("model_id IS NOT NULL").groupBy("field_name", "model_id").agg(F.max("version").alias("own"))
    shared = accepted.where("model_id IS NULL").groupBy("field_name").agg(F.max("version").alias("shared"))
    found = models.select("field_name", "model_id").distinct().join(own, ["field_name", "model_id"], "left").join(shared, "field_name", "left")
    return found.select("field_name", "model_id", F.coalesce("own", "shared").alias("version")).where("version IS NOT NULL")


def of_current_version(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    return rows.join(current_versions(prompts, rows), ["field_name", "model_id", "version"], "left_semi")


def gate_report(rows: DataFrame, prompts: DataFrame, kinds: dict[str, str], least: int = 5, **more) -> DataFrame:
    """Per field and model the gate metric of the answers to its version in force; groups under the least number of rows are left out."""
    answered = of_current_version(rows.where("predicted IS NOT NULL"), prompts)
    return gate_metrics(answered, kinds, ["model_id"], **more).where(F.col("n") >= least)


def report_by_field(report: DataFrame) -> DataFrame:
    """Per field how many models pass, the best, worst and mean metric, and the upper middle one.

    The middle is the metric with half of the others above it, counted over the models by rank of equal metrics, so that
    no list of a field's models is made.
    """
    known = report.where("metric IS NOT NULL")
    total = report.groupBy("field_name").agg(
        F.count_if("passes").alias("n_passing"), F.count("*").alias("n_models"), F.count("metric").alias("_n"), F.max("metric").alias("best"), F.min("metric").alias("worst"), F.avg("metric").alias("mean")
    )
    middle = ranks.ranked_value(known, ["field_name"], "metric", total.select("field_name", (F.col("_n") - F.floor(F.col("_n") / 2)).alias("rank")))
    return total.drop("_n").join(middle.withColumnRenamed("metric", "median"), "field_name", "left")


def holdout_means(rows: DataFrame, holdout: DataFrame, kinds: dict[str, str], **more) -> DataFrame:
    """Per field and prompt version the mean over models of the gate metric on held-out records: how far a prompt carries."""
    held = rows.join(holdout.select("record_id").distinct(), "record_id", "left_semi")
    each = gate_metrics(held, kinds, ["version", "model_id"], **more)
    return each.groupBy("field_name", "version").agg(F.avg("metric").alias("holdout_metric"), F.count("metric").alias("n_models"))


def compared_models(rows: DataFrame, kinds: dict[str, str], **more) -> DataFrame:
    """Per field and model, distilled ones beside the others: gate by kind, cost and footprint for an answer, errors."""
    spent = rows.groupBy("field_name", "model_id").agg(F.sum("cost_usd").alias("cost"), F.sum("co2e_grams").alias("co2e"), F.count("error").alias("n_errors"), F.count("predicted").alias("n_answers"))
    found = spent.join(gate_metrics(rows.where("predicted IS NOT NULL"), kinds, ["model_id"], **more), ["field_name", "model_id"], "left")
    n = F.greatest(F.col("n_answers"), F.lit(1))
    return found.select(
        "field_name", "model_id", "metric_name", "metric", "recall", "floor_ok", F.coalesce("passes", F.lit(False)).alias("passes"),
        (F.col("cost") / n).alias("cost_per_record"), (F.col("co2e") / n).alias("co2e_per_record"), "n_errors",
    )


def model_states(rows: DataFrame, prompts: DataFrame, judgments: DataFrame, iterations: DataFrame, kinds: dict[str, str], **more) -> DataFrame:
    """Per field and model, on its version in force, what the next action depends on: records, judges, gate, optimizer.

    Runs are read once with their judgments, and grouped once; models without runs of that version have none of these.
    """
    key = ["field_name", "model_id"]
    current = current_versions(prompts, rows)
    mine = rows.join(current, [*key, "version"], "left_semi")
    said = judgments.groupBy("run_id").agg(F.count("*").alias("_judged"), F.count_if("verdict").alias("_right"))
    told = mine.join(said, "run_id", "left").groupBy(*key).agg(
        F.countDistinct(F.when(F.col("error").isNull(), F.col("record_id"))).alias("refs"),
        F.count_if(F.col("predicted").isNotNull() & F.col("_judged").isNull()).alias("unjudged"),
        F.coalesce(F.sum("_judged"), F.lit(0)).alias("n_judged"),
        F.try_divide(F.sum("_right"), F.sum("_judged")).alias("judged_accuracy"),
    )
    gate = gate_metrics(mine.where("predicted IS NOT NULL"), kinds, ["model_id"], **more).select(*key, "metric", F.col("n").alias("n_gated"), "floor_ok", "passes")
    last = iterations.groupBy(*key).agg(F.max(F.when(F.col("accepted"), F.col("created_at"))).alias("_last"))
    tried = iterations.join(last, key).join(current.withColumnRenamed("version", "_version"), key, "left").groupBy(*key).agg(
        F.count("*").alias("n_iterations"), F.count_if(F.col("_last").isNull() | (F.col("created_at") > F.col("_last"))).alias("since_accept"),
        F.coalesce(F.max(~F.col("accepted") & (F.col("parent_version") == F.col("_version"))), F.lit(False)).alias("exhausted"),
    )
    found = current.join(told, key, "left").join(gate, key, "left").join(tried, key, "left")
    return found.na.fill(0, ["refs", "unjudged", "n_judged", "n_iterations", "since_accept"]).na.fill(False, ["exhausted"])


def field_states(models: DataFrame) -> DataFrame:
    """Per field the state that next_action reads: its models' least number of records, and how many stand where."""
    gated = F.col("n_gated").isNotNull()
    below = gated & ~F.coalesce("passes", F.lit(False))
    status = gates.stop_status(F.col("n_iterations"), F.col("since_accept"), F.coalesce("metric", F.lit(0.0)), bar(F.col("field_name")))
    return models.groupBy("field_name").agg(
        F.min("refs").alias("refs"), F.sum("unjudged").alias("unjudged"), F.count_if(gated).alias("n_evaluated"), F.count_if(below).alias("n_below"),
        F.count_if(below & (status == "optimize") & ~F.col("exhausted")).alias("n_optimizable"), F.count_if(below & (status != "optimize")).alias("n_flagged"),
        F.coalesce(F.max(gated & F.col("passes")), F.lit(False)).alias("best_passes"),
    )


def human_agreement(pairs: DataFrame, kinds: dict[str, str], best: DataFrame, **more) -> DataFrame:
    """pairs (field_name, predicted: the second reading, truth) -> per field the readers' agreement, its interval, and what the best model is beside it.

    best (field_name, model_id, metric): the models' gate metrics, of which the highest counts. Readings that are left
    blank are no pairs.
    """
    read = pairs.where("size(predicted) > 0 AND truth IS NOT NULL")
    found = gate_metrics(read, kinds, [], **more).select("field_name", "metric_name", F.col("metric").alias("human"), "n")
    low, high = metrics.wilson(F.col("human"), F.col("n"), Z95_SHORT)
    top = best.where("metric IS NOT NULL").groupBy("field_name").agg(F.max(F.struct("metric", "model_id")).alias("top")).select("field_name", F.col("top.model_id").alias("model_id"), F.col("top.metric").alias("model"))
    found = found.withColumn("low", low).withColumn("high", high).join(top, "field_name", "left")
    verdict = F.when(F.col("model").isNull(), "no model runs").when(F.col("model") >= F.col("low"), "model within human range").otherwise("model below human")
    return found.withColumn("verdict", verdict).withColumn("gap", F.when(verdict == "model below human", F.col("human") - F.col("model")))
