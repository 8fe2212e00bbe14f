"""Audits of reference values, proposals and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from . import nearest, passages
from .tables import durable


def audit(truth: DataFrame, allowed: DataFrame) -> DataFrame:
    """truth (record_id, values), allowed (value): one row for each issue found."""
    items = truth.select("record_id", F.explode("values").alias("value")).where("value IS NOT NULL")
    folds = items.select("value").distinct().withColumn("folded", text.display_fold("value"))
    items = items.join(folds, "value")
    lower = F.lower("folded")
    valid = allowed.select(F.lower(text.display_fold("value")).alias("ok")).distinct()
    kind = lambda rows, name: rows.select(F.lit(name).alias("issue"), "record_id", "value")
    no_record = F.lit(None).cast("long").alias("record_id")
    empty = truth.where(F.size(F.filter("values", lambda x: x.isNotNull())) <= 0).select("record_id", F.lit(None).cast("string").alias("value"))
    twice = items.groupBy("record_id", lower.alias("folded")).count().where("count > 1").select("record_id", F.col("folded").alias("value"))
    order = items.where(~F.col("value").contains(",") & (F.size(F.split(F.trim("value"), r"\s+")) >= 2))
    outside = items.join(valid, lower == F.col("ok"), "left_anti")
    rare = items.groupBy("value").count().where("count <= 2").select(no_record, "value")
    parts = [kind(empty, "empty"), kind(items.where("folded <> value"), "encoding_noise"), kind(twice, "duplicate_entry"), kind(order, "name_order"), kind(outside, "not_in_taxonomy"), kind(rare, "rare_category")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def propose(values: DataFrame, allowed: DataFrame, least: float = 85.0) -> DataFrame:
    """Distinct values with what to do: valid, manual_pick, remap to the nearest allowed value, or review.

    Near is by words in any order; of allowed values equally near, or equal in folded form, the first counts: by the
    column rank, or as the table is read. Neither table needs to be small.
    """
    rank = F.col("rank") if "rank" in allowed.columns else F.monotonically_increasing_id()
    sorted_words = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    ready = values.select("value").distinct().withColumn("folded", F.lower(text.display_fold("value")))
    options = allowed.select(F.col("value").alias("option"), F.lower(text.display_fold("value")).alias("option_folded"), rank.alias("rank"))
    options = options.groupBy("option_folded").agg(F.min(F.struct("rank", "option")).alias("o"))
    options = durable(options.select("option_folded", "o.*"))
    marked = ready.join(options.select(F.col("option_folded").alias("folded"), F.lit(True).alias("valid")), "folded", "left")
    open_ = marked.where(F.col("valid").isNull() & ~F.col("value").contains("|"))
    texts = options.groupBy(sorted_words(F.col("option_folded")).alias("text")).agg(F.min("rank").alias("rank"))
    best = nearest.nearest(open_.select("value", sorted_words(F.col("folded")).alias("text")), texts).join(options.select("rank", "option"), "rank")
    near = best.select("value", F.col("option").alias("proposed"), "score", F.when(F.col("score") >= least, "remap").otherwise("review").alias("action"))
    rest = marked.where(F.col("valid").isNotNull() | F.col("value").contains("|"))
    # several values in one cell: the allowed ones among them are proposed, all if none is, for a person to pick
    parts = rest.where("valid IS NULL").select("value", F.posexplode(text.alternatives(F.col("value"))).alias("i", "part"))
    parts = parts.withColumn("part_folded", F.lower(text.display_fold("part"))).join(options.select(F.col("option_folded").alias("part_folded"), F.lit(True).alias("ok")), "part_folded", "left")
    listed = parts.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("i", "part", "ok"))).alias("parts"))
    good = F.filter("parts", lambda x: x["ok"])
    pick = F.array_join(F.transform(F.when(F.size(good) > 0, good).otherwise(F.col("parts")), lambda x: x["part"]), " OR ")
    fixed = rest.join(listed, "value", "left").select("value", F.when(F.col("valid"), F.col("value")).otherwise(pick).alias("proposed"), F.lit(None).cast("double").alias("score"), F.when(F.col("valid"), "valid").otherwise("manual_pick").alias("action"))
    return near.unionByName(fixed)


def decision(cell: Column) -> Column:
    """struct(kind, value): keep, accept, blank, or an edit with its value; any other text is an edit."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    low = F.lower(s)
    edit = low.startswith("edit:")
    kind = F.when(edit, "edit").when(low.isin("keep", "accept", ""), low).otherwise("edit")
    return F.struct(kind.alias("kind"), F.when(edit, F.trim(F.substring(s, F.lit(6), F.length(s)))).when(kind == "edit", s).alias("value"))


def plan_single(reviews: DataFrame, truth: DataFrame) -> DataFrame:
    """reviews (record_id, suggestion, curator_decision): the change of each record, or why there is none."""
    d = decision(F.col("curator_decision"))
    target = F.when(d["kind"] == "accept", F.trim("suggestion")).when(d["kind"] == "edit", d["value"])
    targets = reviews.withColumn("target", F.nullif(target, F.lit(""))).groupBy("record_id").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    planned = targets.where(F.size("targets") > 0).join(truth.select("record_id", F.col("value").alias("old")), "record_id", "left").withColumn("known", F.col("old").isNotNull())
    status = F.when(F.size("targets") > 1, "conflict").when(~F.col("known"), "no_truth").when(F.col("old") == F.col("targets")[0], "unchanged").otherwise("change")
    return planned.select("record_id", "old", F.when(F.size("targets") == 1, F.col("targets")[0]).alias("new"), status.alias("status"))


def likenesses(strings: DataFrame, threshold: float) -> DataFrame:
    """strings (record_id, all: a record's strings) -> (record_id, folds, alike): each string's folded form, and which two name the same.

    Each distinct string is folded once, and each distinct pair that lengths leave open compared once.
    """
    each = strings.select("record_id", F.explode("all").alias("s"))
    folds = each.join(each.select("s").distinct().withColumn("f", text.norm_text("s")), "s").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("s", "f"))).alias("folds"))
    after = lambda x, i: F.transform(F.slice("folds", i + 2, F.size("folds")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    pairs = folds.select("record_id", F.explode(F.flatten(F.transform("folds", after))).alias("p")).select("record_id", "p.x", "p.y")
    n, m = F.length("a"), F.length("b")
    open_ = pairs.select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).distinct().where((F.col("a") == F.col("b")) | (200 * F.least(n, m) >= threshold * (n + m)))
    near = open_.where((F.col("a") == F.col("b")) | (fuzzy.token_sort_ratio("a", "b") >= threshold))
    met = pairs.join(near, (F.col("x.f") == F.col("a")) & (F.col("y.f") == F.col("b"))).groupBy("record_id").agg(F.collect_set(F.struct(F.col("x.s").alias("a"), F.col("y.s").alias("b"))).alias("alike"))
    return folds.join(met, "record_id", "left").withColumn("alike", F.coalesce("alike", F.array().cast("array<struct<a:string,b:string>>")))


def plan_lists(reviews: DataFrame, truth: DataFrame, threshold: float = 90.0) -> DataFrame:
    """reviews (record_id, ordinal, issue_type, value, curator_decision) -> (record_id, old, new, ops) of the records of truth that change.

    A record's decisions are taken one after the other: additions of what isn't there, removals and replacements of
    what is, by folded or nearly equal value. Of values with one folded form the first stays.
    """
    d = decision(F.col("curator_decision"))
    rows = reviews.select("record_id", "ordinal", F.trim(F.coalesce("issue_type", F.lit(""))).alias("issue"), F.trim(F.coalesce("value", F.lit(""))).alias("value"), d["kind"].alias("kind"), F.coalesce(d["value"], F.lit("")).alias("edit"))
    rows = rows.where("kind = 'accept' OR kind = 'edit' AND edit <> ''").withColumn("wanted", F.when(F.col("kind") == "edit", F.col("edit")).otherwise(F.col("value")))
    steps = rows.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "issue", "value", "kind", "wanted"))).alias("steps"))
    ready = steps.join(truth.select("record_id", F.filter(F.coalesce("values", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("old")), "record_id")
    ready = durable(ready.withColumn("all", F.array_distinct(F.concat("old", F.transform("steps", lambda r: r["value"]), F.transform("steps", lambda r: r["wanted"])))))
    ready = ready.join(likenesses(ready.select("record_id", "all"), threshold), "record_id")
    same = lambda x, v: (x == v) | F.exists("alike", lambda y: (y["a"] == x) & (y["b"] == v) | (y["a"] == v) & (y["b"] == x))

    def take(state: Column, r: Column) -> Column:
        work, ops = state["work"], state["ops"]
        at = F.array_position(F.transform(work, lambda x: same(x, r["value"])), F.lit(True))
        there, edit, miss = F.exists(work, lambda x: same(x, r["wanted"])), r["kind"] == "edit", r["issue"] == "recall_miss"
        add = (r["issue"] == "models_agree_gt_lacks") & ~there | miss & edit & (at == 0)
        remove, replace, hit = miss & ~edit & (at > 0), miss & edit & (at > 0), F.get(work, (at - 1).cast("int"))
        new = F.when(add, F.concat(work, F.array(r["wanted"]))).when(remove, F.filter(work, lambda x, i: i + 1 != at)).when(replace, F.transform(work, lambda x, i: F.when(i + 1 == at, r["wanted"]).otherwise(x)))
        op = F.when(add, F.concat(F.lit("add: "), r["wanted"])).when(remove, F.concat(F.lit("remove: "), hit)).when(replace, F.concat(F.lit("replace: "), hit, F.lit(" -> "), r["wanted"]))
        return F.struct(F.coalesce(new, work).alias("work"), F.when(op.isNotNull(), F.concat(ops, F.array(op))).otherwise(ops).alias("ops"))

    first = F.struct(F.col("old").alias("work"), F.array().cast("array<string>").alias("ops"))
    done = ready.withColumn("s", F.aggregate("steps", first, take))
    fold = lambda x: F.filter("folds", lambda y: y["s"] == x)[0]["f"]
    keys = F.transform("s.work", fold)
    done = done.withColumn("keys", keys).withColumn("new", F.filter("s.work", lambda x, i: F.array_position("keys", fold(x)) == i + 1))
    return done.where((F.size("s.ops") > 0) & (F.col("new") != F.col("old"))).select("record_id", "old", "new", F.col("s.ops").alias("ops"))


def apply_changes(truth: DataFrame, changes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The truth with the changes, and the log of them."""
    new = truth.join(changes.select("record_id", F.col("new").alias("_new")), "record_id", "left")
    new = new.withColumn("value", F.coalesce("_new", "value")).drop("_new")
    return new, changes.select(at.alias("applied_at"), "record_id", F.col("old").alias("old_value"), F.col("new").alias("new_value"))


def first_failing(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each reason drops, where the first that holds counts; kept rows under `kept`."""
    reason = F.lit("kept")
    for name, holds in reversed(reasons):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, label: str, rank: list[Column], cap: int) -> DataFrame:
    """At most cap rows of a label, by rank."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*rank))).where(F.col("_r") <= cap).drop("_r")


REASONS = ["gt_leak", "dup", "low_confidence", "low_logprob", "over_cap"]


def training_rows(rows: DataFrame, truth: DataFrame, least_confidence: float = 0.0, least_logprob: float = 0.0, cap: int = 0) -> DataFrame:
    """rows (ordinal, record_id, value, confidence, logprob) with reason: what keeps each out of a training set, or kept.

    As if the rows were taken in order: a record with a truth leaks; one that was kept before is a duplicate; a bound
    of 0 isn't asked for, a missing number is below any other; a value that has cap kept rows is full. Rows are kept
    as records and values would choose each other, both by the smaller ordinal, which gives what taking turns gives:
    each round drops what a full value turns away, and lets the record's next row stand, until none is turned away.
    """
    marked = passages.with_truth(rows, truth)
    low = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True)) if least else F.lit(False)
    marked = marked.withColumn("unsure", low("confidence", least_confidence)).withColumn("unlikely", low("logprob", least_logprob))
    able = marked.where("NOT leak AND NOT unsure AND NOT unlikely").select("ordinal", "record_id", "value")
    cut = None
    while True:
        standing = able if cut is None else able.join(cut, F.col("value").eqNullSafe(F.col("_full")), "left").where("_last IS NULL OR ordinal <= _last").select(*able.columns)
        first = standing.groupBy("record_id").agg(F.min_by(F.struct("ordinal", "value"), "ordinal").alias("x")).select("record_id", "x.*")
        if not cap:
            break
        turned = first.withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy("ordinal"))).where(F.col("_n") == cap)
        new = durable(turned.select(F.col("value").alias("_full"), F.col("ordinal").alias("_last")))
        if cut is not None and new.exceptAll(cut).isEmpty():
            break
        cut = new
    kept = first.select("record_id", F.col("ordinal").alias("_kept"))
    told = marked.join(kept, marked["record_id"].eqNullSafe(kept["record_id"]), "left").drop(kept["record_id"])
    reason = (
        F.when(F.col("leak"), "gt_leak").when(F.col("ordinal") > F.col("_kept"), "dup").when(F.col("unsure"), "low_confidence")
        .when(F.col("unlikely"), "low_logprob").when(F.col("ordinal") == F.col("_kept"), "kept").otherwise("over_cap")
    )
    return told.select(*rows.columns, reason.alias("reason"))
