"""Joins of runs, records, truth, prompts and projects, and the lists that a user sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

PROJECT = "fields array<struct<name:string,label:string,type:string,description:string>>, exclusion_criteria array<struct<tag:string,question:string>>"
SLUG = "^[a-z0-9][a-z0-9-]{1,60}$"


def decoded(value: Column) -> Column:
    """A value stored as JSON: a string's text, other JSON as it is written, and what isn't JSON as raw text."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(value), "$", "string"), value)


def with_truth(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """The runs that have an answer, each with the truth of its record and field: an equi-join on both keys."""
    return runs.where("predicted IS NOT NULL").join(truth, ["record_id", "field_name"])


def records_with_truth(records: DataFrame, truth: DataFrame, field: str, limit: int | None = None) -> DataFrame:
    """The records that have a truth for field, by id; only the first ones if a limit is asked for."""
    found = records.join(truth.where(F.col("field_name") == field), "record_id").orderBy("record_id")
    return found if limit is None else found.limit(limit)


def of_version(runs: DataFrame, versions: DataFrame, requested: int | None) -> DataFrame:
    """All runs if no version is asked for, else those of that version; none if it isn't known."""
    if requested is None:
        return runs
    return runs.join(versions.where(F.col("version") == requested).select("version").distinct(), "version", "left_semi")


def complete_with_stratum(records: DataFrame, truth: DataFrame, fields: list[str], stratum: str) -> DataFrame:
    """Records with a truth for every field, and the truth of one field as their stratum: one grouping, one join."""
    value = F.max(F.when(F.col("field_name") == stratum, F.col("value_json")))
    found = truth.where(F.col("field_name").isin(fields)).groupBy("record_id").agg(F.countDistinct("field_name").alias("n"), value.alias("stratum"))
    return records.join(found.where(F.col("n") == len(fields)).drop("n"), "record_id")


def exhausted(incumbents: DataFrame, iterations: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per model and prompt whether a child of the prompt was already rejected for that model."""
    rejected = iterations.where("NOT accepted").join(prompts.select("prompt_id", "parent_id"), "prompt_id")
    gone = rejected.select("model_id", F.col("parent_id").alias("prompt_id"), F.lit(True).alias("gone")).where("prompt_id IS NOT NULL").distinct()
    return incumbents.join(gone, ["model_id", "prompt_id"], "left").withColumn("exhausted", F.col("gone").isNotNull()).drop("gone")


def projects(static: DataFrame, stored: DataFrame) -> DataFrame:
    """The built-in projects and the stored ones whose slug isn't taken; a missing description is empty."""
    free = stored.join(static.select("slug"), "slug", "left_anti")
    return static.unionByName(free).withColumn("description", F.coalesce("description", F.lit("")))


def field_specs(stored: DataFrame) -> DataFrame:
    """A row for each field that a project's config declares; the label defaults to the name, the type to text."""
    field = stored.select("slug", F.explode(F.from_json("config", PROJECT)["fields"]).alias("f"))
    text = F.coalesce("f.description", F.lit(""))
    return field.select("slug", "f.name", F.coalesce("f.label", "f.name").alias("label"), F.coalesce("f.type", F.lit("text")).alias("type"), text.alias("description"))


def created(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The new projects with a valid slug that isn't taken."""
    return new.where(F.col("slug").rlike(SLUG)).join(existing.select("slug"), "slug", "left_anti")


def baseline_prompts(stored: DataFrame, prompts: DataFrame) -> DataFrame:
    """The first prompt of every field and criterion of a project that has none yet."""
    config = F.from_json("config", PROJECT)
    of_field = F.transform(config["fields"], lambda f: F.struct(f["name"].alias("field_name"), F.coalesce(f["description"], F.lit("")).alias("template")))
    told = F.filter(config["exclusion_criteria"], lambda c: (F.trim(c["tag"]) != "") & (F.trim(c["question"]) != ""))
    of_tag = F.transform(told, lambda c: F.struct(F.trim(c["tag"]).alias("field_name"), F.trim(c["question"]).alias("template")))
    none = F.array().cast("array<struct<field_name:string,template:string>>")
    wanted = stored.select("slug", F.explode(F.concat(F.coalesce(of_field, none), F.coalesce(of_tag, none))).alias("p")).select("slug", "p.*")
    return wanted.dropDuplicates(["slug", "field_name"]).join(prompts.select("slug", "field_name"), ["slug", "field_name"], "left_anti").withColumn("version", F.lit(1))


def add_versions(new: DataFrame, prompts: DataFrame) -> DataFrame:
    """New accepted prompts, one a model, numbered after the model's last one; the parent is its best accepted one."""
    accepted = F.when(F.col("accepted"), F.col("version"))
    last = prompts.groupBy("model_id").agg(F.max("version").alias("last"), F.max_by("prompt_id", F.when(F.col("accepted"), F.struct("version", "prompt_id"))).alias("parent_id"), F.count(accepted).alias("n"))
    found = new.join(last, "model_id", "left")
    return found.select(*new.columns, (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.when(F.col("n") > 0, F.col("parent_id")).alias("parent_id"), F.lit(True).alias("accepted"))


def two_step(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The second step's runs with the first step's answer as context; none where that one is blank."""
    context = first.where("predicted IS NOT NULL AND predicted <> ''").groupBy(*keys).agg(F.max_by("predicted", F.struct("created_at", "run_id")).alias("context"))
    return second.join(context, keys, "left")


def user_order(column: str, descending: bool) -> Column:
    """The order a user asks for; nulls come last in both directions."""
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def percent_floor(share: Column) -> Column:
    """A share as whole percent, rounded down, so that nothing below a gate looks like the gate."""
    return F.floor(share * 100)


def delta_points(share: Column, before: Column) -> Column:
    """The change in points of the raw shares, halves up."""
    return F.floor((share - before) * 100 + 0.5)


def corpus_path(folder: str, key: str) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/")), F.concat(F.col(key).cast("string"), F.lit(".md")))


def excerpt_stands(excerpt: Column, text: Column) -> Column:
    """1 if the excerpt is in the text letter for letter, 0 if not, null without an excerpt."""
    return F.when(F.coalesce(excerpt, F.lit("")) != "", F.coalesce(text, F.lit("")).contains(excerpt).cast("int"))


def decision_counts(rows: DataFrame, decision: str) -> DataFrame:
    word = F.upper(F.trim(decision))
    return rows.agg(F.count("*").alias("total"), F.count_if(word.startswith("INCLUDE")).alias("n_include"), F.count_if(word.startswith("EXCLUDE")).alias("n_exclude"))


def tag_counts(rows: DataFrame, decision: str, order: str) -> DataFrame:
    """Per reason of exclusion its tag, the wording seen first, and its count, commonest first; no reason, no row."""
    rest = F.trim(F.substring(F.trim(decision), 8, 1_000_000))
    said = rows.where(F.upper(F.trim(decision)).startswith("EXCLUDE")).select(order, rest.alias("label"))
    tag = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    found = said.withColumn("tag", tag).where("tag <> ''").groupBy("tag")
    return found.agg(F.min_by("label", order).alias("label"), F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def newest(rows: DataFrame, order: list[str], asked: int | None = None) -> DataFrame:
    """The newest rows: 200, or as many as are asked for, held in 1 to 2000."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(200 if asked is None else max(1, min(2000, asked)))


def by_slug(projects: DataFrame, slug: str) -> DataFrame:
    """The one project with the slug; an error that names it if there is none."""
    found = projects.where(F.col("slug") == slug)
    if found.isEmpty():
        raise LookupError(f"no project with the slug {slug!r}")
    return found.limit(1)


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with these ids, in the order of the ids; ids without a row give none."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").orderBy(key)


def not_in(values: str, others: str) -> Column:
    """The values whose folded form isn't among the others', each folded form once, in their order."""
    fold = lambda x: text.norm_ascii(x)
    mine, theirs = F.transform(values, fold), F.transform(others, fold)
    return F.filter(values, lambda x, i: ~F.array_contains(theirs, fold(x)) & (F.array_position(mine, fold(x)) == i + 1))
