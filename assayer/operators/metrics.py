"""Quality metrics of (truth, predicted) rows, per group and in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Z95, T
from ..functions import text
from . import ranks, scoring
from .summaries import rate
from .tables import durable

OTHER, NONE = "(other)", "(none)"


def fbeta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The interval of a proportion, held in 0..1; null without rows."""
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - spread)), F.when(ok, F.least(F.lit(1.0), centre + spread))


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with a truth; a null prediction is the empty label."""
    return rows.where("truth IS NOT NULL AND truth <> ''").withColumn("predicted", F.coalesce("predicted", F.lit("")))


def cell_counts(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, truth, predicted, n, seen): how often each pair of labels occurs, and first where: what all of these metrics are made of."""
    return rows.where("truth IS NOT NULL AND truth <> ''").groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"), F.min(order).alias("seen"))


def kappa(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cohen's kappa; null without rows or if chance agreement is 1."""
    return kappa_of(labelled(rows).groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n")), by)


def kappa_of(cells: DataFrame, by: list[str]) -> DataFrame:
    """Kappa from cells (by, truth, predicted, n); a null prediction is the empty label."""
    cells = cells.withColumn("predicted", F.coalesce("predicted", F.lit("")))
    sides = [cells.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("truth", "predicted")]
    chance = sides[0].join(sides[1], [*by, "label"]).groupBy(*by).agg(F.sum(F.col("truth").cast("double") * F.col("predicted")).alias("met"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("agreed"))
    found = total.join(chance, by, "left").withColumn("po", F.col("agreed") / F.col("n")).withColumn("pe", F.coalesce("met", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n")))
    return found.select(*by, "n", F.col("po").alias("accuracy"), F.try_divide(F.col("po") - F.col("pe"), F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"))


def confusion_cells(rows: DataFrame, by: list[str], order: str, most: int = T.visible_classes) -> DataFrame:
    """Cells of the confusion matrix over the commonest truths, ties by first seen; the rest is (other)."""
    return confusion_of(cell_counts(rows, by, order), by, most)


def confusion_of(cells: DataFrame, by: list[str], most: int = T.visible_classes) -> DataFrame:
    """The confusion matrix from cells (by, truth, predicted, n, seen)."""
    counts = cells.groupBy(*by, "truth").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, F.col("truth").alias("label"))
    as_truth = top.select(*by, F.col("label").alias("truth"), F.col("label").alias("truth_label"))
    as_predicted = top.select(*by, F.col("label").alias("predicted"), F.col("label").alias("predicted_label"))
    shown = cells.join(as_truth, [*by, "truth"], "left").join(as_predicted, [*by, "predicted"], "left")
    predicted = F.when(F.coalesce("predicted", F.lit("")) == "", NONE).otherwise(F.coalesce("predicted_label", F.lit(OTHER)))
    return shown.groupBy(*by, F.coalesce("truth_label", F.lit(OTHER)).alias("truth_label"), predicted.alias("predicted_label")).agg(F.sum("n").alias("n"))


def one_vs_rest(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per group macro sensitivity, specificity and F2 over the matrix's truth labels, and if each class has support."""
    truth = cells.groupBy(*by, F.col("truth_label").alias("label")).agg(F.sum("n").alias("in_truth"), F.sum(F.when(F.col("truth_label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(*by, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("in_predicted"))
    total = F.sum("in_truth").over(Window.partitionBy(*by))
    each = truth.join(predicted, [*by, "label"], "left").withColumn("in_predicted", F.coalesce("in_predicted", F.lit(0))).withColumn("total", total)
    tp, fn, fp = F.col("tp"), F.col("in_truth") - F.col("tp"), F.col("in_predicted") - F.col("tp")
    tn = F.col("total") - tp - fn - fp
    each = each.withColumn("sens", rate(tp, tp + fn)).withColumn("spec", rate(tn, tn + fp)).withColumn("prec", rate(tp, tp + fp))
    real = F.col("label") != OTHER
    thin = F.count_if(real & (F.col("in_truth") < T.class_support))
    return each.groupBy(*by).agg(
        F.avg("sens").alias("sensitivity"),
        F.avg("spec").alias("specificity"),
        F.avg(fbeta(F.col("prec"), F.col("sens"), 2.0)).alias("f2"),
        thin.alias("n_undersampled"),
        ((thin == 0) & (F.count_if(real) >= T.least_classes)).alias("sensitivity_gateable"),
    )


def categorical(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Kappa and one-vs-rest metrics, from cells that are counted once."""
    return categorical_of(durable(cell_counts(rows, by, order)), by)


def categorical_of(cells: DataFrame, by: list[str]) -> DataFrame:
    return kappa_of(cells, by).join(one_vs_rest(confusion_of(cells, by), by), by)


def common(predicted: Column, truth: Column) -> Column:
    """tp of greedy one-to-one matching by equality: for each value the lesser of its counts."""
    each = F.array_distinct(predicted)
    count = lambda values, v: F.size(F.filter(values, lambda x: x == v))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.least(count(predicted, v), count(truth, v)))


def list_metrics(rows: DataFrame, by: list[str], universe: int | None = None, field: str = "", is_fuzzy: bool = False) -> DataFrame:
    """Micro tp, fp, fn and what follows; specificity only for a closed vocabulary of universe values.

    Values match as in single scores: folded, for authors by their names, and nearly where the field is fuzzy. A null
    list is an empty one.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("predicted", "truth")})
    if field == "authors" or is_fuzzy:
        ready = rows.withColumn("_p", F.col("predicted")).withColumn("_t", F.col("truth"))
        found = scoring.matched(ready.select("_p", "_t").distinct(), field, is_fuzzy)
        rows, tp = ready.join(found, ["_p", "_t"]), F.col("m.tp")
    else:
        rows, tp = rows.withColumns({c: text.norm_list(c) for c in ("predicted", "truth")}), common(F.col("predicted"), F.col("truth"))
    n_p, n_t = F.size("predicted"), F.size("truth")
    negatives = F.greatest(F.lit(0), F.lit(universe) - F.size(F.array_distinct("truth")))
    counted = rows.select(*by, tp.alias("tp"), (n_p - tp).alias("fp"), (n_t - tp).alias("fn"), F.greatest(F.lit(0), negatives - (n_p - tp)).alias("tn"))
    total = counted.groupBy(*by) if by else counted
    found = total.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")) if universe else F.lit(None).cast("double")
    return found.select(*by, "n", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), fbeta(precision, recall).alias("f1"), fbeta(precision, recall, 2.0).alias("f2"), specificity.alias("specificity"))


def calibration_bins(runs: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Per group its Brier score, and each bin of confidence, empty ones too; the last bin holds 1."""
    known = runs.where("confidence IS NOT NULL AND is_correct IS NOT NULL").withColumn("right", F.col("is_correct").cast("double"))
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    brier = known.groupBy(*by).agg(F.avg(F.pow(F.col("confidence") - F.col("right"), F.lit(2))).alias("brier"))
    filled = known.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("right").alias("accuracy"))
    every = brier.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(filled, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def agreement(answers: DataFrame, field: str = "", kind: str = "single_categorical") -> DataFrame:
    """Per model the mean share of other models whose answer its own matches, over records that two or more answered.

    An answer matches another if it scores at least the bar with the other as the truth.
    """
    mine, other = (answers.select("record_id", F.col("model_id").alias(f"{x}_model"), F.col("value").alias(c)) for x, c in (("own", "predicted"), ("other", "truth")))
    pairs = mine.join(other, "record_id").where("own_model <> other_model").withColumn("excerpt_verified", F.lit(None).cast("boolean"))
    scored = scoring.field_scores(pairs, field, kind)
    share = scored.groupBy("record_id", F.col("own_model").alias("model_id")).agg(F.avg((F.col("result.score") >= T.list_correct).cast("double")).alias("share"))
    return share.groupBy("model_id").agg(F.avg("share").alias("agreement"), F.count("*").alias("n_records"))


def threshold_sweep(rows: DataFrame, score: str, truth: str, low: float = 0.50, step: float = 0.05, n: int = 11) -> DataFrame:
    """Precision, recall and F1 of score >= threshold against a verdict, for each threshold, in one aggregation."""
    cells = rows.groupBy(F.col(score).alias("s"), F.col(truth).alias("t")).agg(F.count("*").alias("c"))
    marks = cells.sparkSession.range(n).select(F.round(F.lit(low) + F.col("id") * step, 2).alias("threshold"))
    met = cells.crossJoin(F.broadcast(marks)).withColumn("yes", F.col("s") >= F.col("threshold"))
    total = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    found = met.groupBy("threshold").agg(total(F.col("yes") & F.col("t")).alias("tp"), total(F.col("yes") & ~F.col("t")).alias("fp"), total(~F.col("yes") & F.col("t")).alias("fn"))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return found.select("threshold", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), fbeta(precision, recall).alias("f1"))


def work_saved(bins: DataFrame, by: list[str]) -> DataFrame:
    """Along falling confidence the share of answers accepted and their accuracy, in percent to one place."""
    order = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    full = bins.where("n > 0").withColumn("upto", F.sum("n").over(order)).withColumn("right", F.sum(F.col("n") * F.col("accuracy")).over(order))
    whole = F.sum("n").over(Window.partitionBy(*by))
    return full.withColumn("whole", whole).select(*by, "bin", F.round(100 * F.col("upto") / F.col("whole"), 1).alias("share_pct"), F.round(100 * F.col("right") / F.col("upto"), 1).alias("accuracy_pct"))


def share_at(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """The share at which the curve's accuracy falls to target, between its points in a straight line; ends clamp."""
    order = Window.partitionBy(*by).orderBy("share_pct")
    steps = curve.withColumn("next_share", F.lead("share_pct").over(order)).withColumn("next_accuracy", F.lead("accuracy_pct").over(order))
    inside = (F.col("accuracy_pct") >= target) & (F.col("next_accuracy") < target)
    cross = F.col("share_pct") + (F.col("accuracy_pct") - target) / (F.col("accuracy_pct") - F.col("next_accuracy")) * (F.col("next_share") - F.col("share_pct"))
    first = steps.groupBy(*by).agg(F.min(F.when(inside, cross)).alias("cross"), F.min_by("accuracy_pct", "share_pct").alias("head"), F.max("share_pct").alias("whole"))
    return first.select(*by, F.when(F.col("head") < target, 0.0).otherwise(F.coalesce("cross", "whole")).alias("share_pct"))


def work_saved_exact(runs: DataFrame, by: list[str]) -> DataFrame:
    """The curve on single answers: one row for each confidence, ties together."""
    each = runs.where("confidence IS NOT NULL").groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("right"))
    upto = ranks.running(each, by, "confidence", ["n", "right"], descending=True)
    return upto.select(*by, "confidence", (F.col("upto_n") / F.col("whole_n")).alias("share"), (F.col("upto_right") / F.col("upto_n")).alias("accuracy"))
