"""Scores of single answers: exact tests in columns first, Arrow UDFs on the distinct pairs that are left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..config import T
from ..functions import fuzzy, names, parsing, text
from .tables import durable, spread

def result(score: Column, outcome: Column, honesty: Column) -> Column:
    return F.struct(score.alias("score"), (score >= T.list_correct).alias("is_correct"), outcome.alias("outcome"), honesty.alias("honesty_score"))


def single(rows: DataFrame) -> DataFrame:
    """rows (predicted, truth strings) with result: a match with any alternative, in folded form or nearly."""
    pairs = rows.select("predicted", "truth").distinct()
    p, t = F.coalesce("predicted", F.lit("")), F.coalesce("truth", F.lit(""))
    each = pairs.withColumn("p", p).withColumn("t", t).where("p <> '' AND t <> ''").withColumn("alternative", F.explode(text.alternatives(F.col("t"))))
    each = each.withColumn("pn", text.norm_text("p")).withColumn("tn", text.norm_text("alternative"))
    each = each.withColumn("exact", text.category_fold(F.col("pn")) == text.category_fold(F.col("tn")))
    best = each.where("exact").select("predicted", "truth").distinct().withColumn("credit", F.lit(1.0))
    left = each.join(best, ["predicted", "truth"], "left_anti").where(fuzzy.may_be_same(F.col("pn"), F.col("tn"), T.fuzzy))
    near = left.where(similar_at(T.fuzzy)("pn", "tn")).select("predicted", "truth").distinct().withColumn("credit", F.lit(T.fuzzy_credit))
    found = rows.join(best.unionByName(near), ["predicted", "truth"], "left")  # pairs with a blank side have no credit
    credit = F.coalesce("credit", F.lit(0.0))
    cases = (
        F.when((t == "") & (p == ""), result(F.lit(1.0), F.lit("correct_abstain"), F.lit(1.0)))
        .when(t == "", result(F.lit(0.0), F.lit("hallucination"), F.lit(0.0)))
        .when(p == "", result(F.lit(0.0), F.lit("abstain_miss"), F.lit(T.abstention_credit)))
        .otherwise(result(credit, F.when(credit > 0, "hit").otherwise("wrong"), credit))
    )
    return found.withColumn("result", cases).drop("credit")


def same_pairs(pairs: DataFrame, field: str, is_fuzzy: bool) -> DataFrame:
    """Of distinct value pairs (p, t) those that name the same thing. Python sees only what columns leave open."""
    ready = pairs.withColumn("pn", text.norm_text("p")).withColumn("tn", text.norm_text("t"))
    exact = F.col("pn") == F.col("tn")
    if field == "authors":
        exact = exact | names.authors_equal(F.col("p"), F.col("t"))
    told = ready.withColumn("exact", exact)
    found = told.where("exact").select("p", "t")
    if not is_fuzzy:
        return found
    limit = T.fuzzy_authors if field == "authors" else T.fuzzy
    open_ = told.where(~F.col("exact") & fuzzy.may_be_same(F.col("pn"), F.col("tn"), limit))
    return found.unionByName(open_.where(similar_at(limit)("pn", "tn")).select("p", "t"))


def similar_at(limit: float):
    @F.pandas_udf(types.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.same_value(x, y, limit) for x, y in zip(a, b, strict=True)], dtype=bool)

    return run


def matched(pairs: DataFrame, field: str, is_fuzzy: bool) -> DataFrame:
    """Distinct list pairs (_p, _t) with m: greedy one-to-one matching of predicted with true values, in their order.

    List pairs are numbered, so that their cells move without the lists. Each distinct pair of values is judged
    once, whatever lists it stands in; the lists then only hold which of their positions go together.
    """
    pairs = durable(pairs.select("_p", "_t").withColumn("_id", F.monotonically_increasing_id()))
    each = pairs.select("_id", "_t", F.posexplode("_p").alias("pi", "p")).select("_id", "pi", "p", F.posexplode("_t").alias("ti", "t"))
    same = durable(same_pairs(each.select("p", "t").distinct(), field, is_fuzzy))  # where it is small, the cells needn't be dealt by it
    alike = each.join(same, ["p", "t"]).groupBy("_id").agg(F.collect_set(F.struct("pi", "ti")).alias("alike"))
    none = F.array().cast("array<struct<pi:int,ti:int>>")
    joined = pairs.join(alike, "_id", "left").withColumn("alike", F.coalesce("alike", none))

    def take(taken: Column, i: Column) -> Column:
        free = F.filter("alike", lambda x: (x["pi"] == i) & ~F.exists(taken, lambda y: y["ti"] == x["ti"]))
        return F.concat(taken, F.slice(F.sort_array(free), 1, 1))

    order = F.when(F.size("_p") > 0, F.sequence(F.lit(0), F.size("_p") - 1)).otherwise(F.array().cast("array<int>"))
    done = joined.withColumn("taken", F.aggregate(order, none, take))
    left = lambda values, side: F.filter(values, lambda x, i: ~F.exists("taken", lambda y: y[side] == i))
    found = F.struct(F.size("taken").alias("tp"), F.size("_p").alias("n_predicted"), F.size("_t").alias("n_truth"), left("_t", "ti").alias("missing"), left("_p", "pi").alias("extra"))
    return done.select("_p", "_t", found.alias("m"))


def normalised_values(field: str, values: Column, countries: list[str]) -> Column:
    """Each value in its canonical form for the field."""
    canonical = {"author_country": lambda x: names.country(x, countries), "author_affiliation": names.institution}.get(field, lambda x: x)
    return F.transform(values, lambda x: F.when(text.is_missing(x), text.MISSING).otherwise(canonical(x)))


def lists(rows: DataFrame, field: str, is_fuzzy: bool, countries: list[str] | None = None) -> DataFrame:
    """rows (predicted, truth lists) with result, missing and extra."""
    values = lambda c: normalised_values(field, F.coalesce(c, F.array().cast("array<string>")), countries or [])
    ready = durable(spread(rows).withColumn("_p", values(F.col("predicted"))).withColumn("_t", values(F.col("truth"))))
    found = ready.join(matched(ready.select("_p", "_t").distinct(), field, is_fuzzy), ["_p", "_t"])
    tp, n_p, n_t = F.col("m.tp"), F.col("m.n_predicted"), F.col("m.n_truth")
    precision, recall = F.try_divide(tp, n_p), F.try_divide(tp, n_t)
    softened = F.try_divide(tp + T.abstention_credit * (n_t - tp), n_t)
    harmonic = lambda a, b: F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))
    f1 = harmonic(precision, recall)
    outcome = F.when(f1 >= T.list_correct, "hit").when(F.size("m.extra") == 0, "abstain_miss").otherwise("wrong")
    cases = (
        F.when((n_t == 0) & (n_p == 0), result(F.lit(1.0), F.lit("correct_abstain"), F.lit(1.0)))
        .when(n_t == 0, result(F.lit(0.0), F.lit("hallucination"), F.lit(0.0)))
        .when(n_p == 0, result(F.lit(0.0), F.lit("abstain_miss"), F.lit(T.abstention_credit)))
        .otherwise(result(f1, outcome, F.greatest(f1, harmonic(precision, softened))))
    )
    return found.withColumn("result", cases).select(*rows.columns, "result", "m.missing", "m.extra", "m.tp", "m.n_predicted", "m.n_truth")


def penalised(honesty: Column, excerpt_verified: Column, answered: Column) -> Column:
    """Half the honesty for an answer whose cited excerpt isn't in the source."""
    return F.when(F.coalesce(~excerpt_verified, F.lit(False)) & answered, honesty * T.excerpt_penalty).otherwise(honesty)


def field_scores(rows: DataFrame, field: str, kind: str, countries: list[str] | None = None) -> DataFrame:
    """rows (predicted, truth, excerpt_verified) scored by the field's kind of value, honesty docked for a made-up excerpt.

    predicted and truth are strings for single_categorical, lists for list_categorical and list_text.
    """
    if kind == "single_categorical":
        found, answered = single(rows), F.coalesce("predicted", F.lit("")) != ""
    elif kind in ("list_categorical", "list_text"):
        found, answered = lists(rows, field, kind == "list_text", countries), F.coalesce(F.size("predicted"), F.lit(0)) > 0
    else:
        raise ValueError(f"unknown kind of value: {kind}")
    honesty = penalised(F.col("result.honesty_score"), F.col("excerpt_verified"), answered)
    return found.withColumn("result", F.col("result").withField("honesty_score", honesty)).select(*rows.columns, "result")


def screening(decision: Column, tag: Column, truth: Column, truth_tag: Column) -> Column:
    """struct(score, outcome): maybe is half right; a wrong tag is told but costs nothing; an empty tag matches none."""
    d, t = F.upper(decision), F.upper(truth)
    a, b = F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lower(F.trim(F.coalesce(truth_tag, F.lit(""))))
    tagged = (a != "") & (b != "") & (b.contains(a) | a.contains(b))
    right = F.when((t == "EXCLUDE") & ~tagged, "correct_wrong_tag").otherwise("correct")
    outcome = F.when(d == "MAYBE", F.concat(F.lit("maybe_vs_"), F.lower(t))).when(d == t, right).otherwise(F.concat(F.lit("wrong_"), F.lower(d), F.lit("_vs_"), F.lower(t)))
    return F.struct(F.when(d == "MAYBE", 0.5).when(d == t, 1.0).otherwise(0.0).alias("score"), outcome.alias("outcome"))


def verify_excerpts(rows: DataFrame, excerpt: str, source: str) -> DataFrame:
    """rows with verified: null if either is blank; found word for word, or nearly by the best stretch of the source."""
    blank = (F.trim(F.coalesce(excerpt, F.lit(""))) == "") | (F.trim(F.coalesce(source, F.lit(""))) == "")
    verified = fuzzy.stands_in(T.excerpt_match)(text.norm_text(excerpt), text.norm_text(source))
    return rows.withColumn("verified", F.when(~blank, verified))


def rescored(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose score moved by more than 1e-9 or whose verdict turned."""
    joined = old.join(new.select(key, F.col("score").alias("new_score"), F.col("is_correct").alias("new_is_correct")), key)
    return joined.where((F.abs(F.col("score") - F.col("new_score")) > 1e-9) | ~F.col("is_correct").eqNullSafe(F.col("new_is_correct")))


def consensus(samples: DataFrame, keys: list[str], order: str, value: str, field: str = "", kind: str = "single_categorical") -> DataFrame:
    """Per key the head of the largest cluster of answers that score alike, the earliest of ties, and its share.

    Answers, in order, join the first cluster whose head they match (score at least the bar, by the field's kind of
    value: value is a string, or a list for list_categorical and list_text). Equal answers are one row with their count
    before that, so a key's clusters are built from its distinct answers; a key with one is settled by that.
    """
    counts = samples.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    listed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", F.col("_v").alias("v"), "n"))).alias("answers"), F.sum("n").alias("n_samples"))
    settled = listed.where(F.size("answers") == 1).select(*keys, "n_samples", F.col("answers")[0]["v"].alias("modal_value"), F.lit(1.0).alias("agreement"))
    listed = listed.where(F.size("answers") > 1)
    before = lambda x, i: F.transform(F.slice("answers", F.lit(1), i), lambda y: F.struct(x["v"].alias("v"), y["v"].alias("head")))
    met = listed.select(*keys, F.explode(F.flatten(F.transform("answers", before))).alias("x")).select(*keys, "x.*")
    single_value = kind == "single_categorical"
    as_scored = (lambda c: F.col(c).cast("string")) if single_value else F.col
    distinct = met.select("v", "head").distinct().select(F.col("v").alias("_answer"), F.col("head").alias("_head"), as_scored("v").alias("predicted"), as_scored("head").alias("truth"))
    scored = single(distinct) if single_value else lists(distinct, field, kind == "list_text")
    scored = scored.where(F.col("result.score") >= T.list_correct)
    fits = met.join(scored.select("_answer", "_head"), F.col("v").eqNullSafe(F.col("_answer")) & F.col("head").eqNullSafe(F.col("_head")))
    alike = fits.groupBy(*keys).agg(F.collect_set(F.struct("v", "head")).alias("alike"))
    kind_of = samples.schema[value].dataType.simpleString()
    none = F.array().cast(f"array<struct<v:{kind_of},head:{kind_of}>>")
    joined = listed.join(alike, keys, "left").withColumn("alike", F.coalesce("alike", none))

    def place(clusters: Column, x: Column) -> Column:
        fits = F.transform(clusters, lambda c: F.exists("alike", lambda y: y["v"].eqNullSafe(x["v"]) & y["head"].eqNullSafe(c["head"])))
        at = F.array_position(fits, F.lit(True))
        grown = F.transform(clusters, lambda c, i: F.struct(c["head"].alias("head"), (c["n"] + F.when(i + 1 == at, x["n"]).otherwise(0)).alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(clusters, F.array(F.struct(x["v"].alias("head"), x["n"].alias("n")))))

    clusters = F.aggregate("answers", F.array().cast(f"array<struct<head:{kind_of},n:bigint>>"), place)
    most = F.array_max(F.transform("clusters", lambda c: c["n"]))
    top = F.filter("clusters", lambda c: c["n"] == F.col("most"))[0]
    found = joined.withColumn("clusters", clusters).withColumn("most", most).withColumn("top", top)
    return found.select(*keys, "n_samples", F.col("top.head").alias("modal_value"), (F.col("top.n") / F.col("n_samples")).alias("agreement")).unionByName(settled)


def consistency_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of consensus rows how many there are, their mean agreement, and how many agree in full."""
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.avg("agreement").alias("mean_agreement"), F.count_if(F.col("agreement") == 1.0).alias("n_unanimous"))


def retried(runs: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """New runs for the keys all of whose runs failed: replies (keys, raw, truth) parsed and scored, ready to be appended.

    A reply without a JSON object is a failed run again, and has no score.
    """
    failed = runs.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("_ok")).where("_ok = 0").select(*keys)
    told = replies.join(failed, keys, "left_semi").withColumn("_object", parsing.json_object(F.col("raw")))
    told = told.withColumn("predicted", parsing.scalar_answer(F.col("_object"))).withColumn("error", F.when(F.col("_object").isNull(), "no JSON object in the reply")).drop("_object")
    scored = single(told)
    return scored.withColumn("result", F.when(F.col("error").isNull(), F.col("result")))
