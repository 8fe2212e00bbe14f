"""The evaluation domain's tables, derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = {"purchase": "hit", "signup": "correct_abstain", "view": "abstain_miss", "click": "wrong", "error": "hallucination"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(value: Column, choices: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for key, result in choices.items():
        found = F.when(value == key, result).otherwise(found)
    return found


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer of a model to a field of a record. Pruned and filtered at the scan by what a query asks for."""
    k = F.get_json_object("props", "$.k").cast("int")
    base = table(spark, sf_dir, "events").withColumn("k", k).withColumn("outcome", chosen(F.col("event_type"), OUTCOMES))
    error = F.when(F.col("k") % 20 == 0, "simulated")
    truth = F.concat(F.lit("c"), (F.col("user_id") % 15).cast("string"))
    right = F.col("outcome").isin("hit", "correct_abstain")
    return base.select(
        F.col("event_id").alias("run_id"),
        F.expr("event_id div 4").alias("record_id"),
        F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model_id"),
        (F.col("user_id") % 3 + 1).cast("int").alias("version"),
        F.col("ts").alias("created_at"),
        "k",
        "outcome",
        right.alias("is_correct"),
        (F.col("k") / F.lit(100.0)).cast("double").alias("confidence"),
        error.alias("error"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(F.col("k") % 4 != 0, F.col("k") / F.lit(200.0)).cast("double").alias("logprob_confidence"),
        (F.col("value") / 1000).alias("cost_usd"),
        (F.col("value") / 100).alias("co2e_grams"),
        F.when(right, 1.0).otherwise(0.0).alias("score"),
        F.when(right, 1.0).when(F.col("outcome") == "abstain_miss", 0.5).otherwise(0.0).alias("honesty_score"),
        F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False).alias("excerpt_verified"),
        truth.alias("truth"),
        F.when(error.isNull(), F.when(F.col("k") % 10 < 7, truth).otherwise(F.concat(F.lit("c"), (F.col("k") % 17).cast("string")))).alias("predicted"),
    )


def prompt_versions(spark: SparkSession) -> DataFrame:
    return spark.range(1, 4).select(F.col("id").cast("int").alias("version"), (F.col("id") != 2).alias("accepted"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).where("run_id % 3 <> 0")
    verdict = F.when(F.col("k") % 8 == 0, ~F.col("is_correct")).otherwise(F.col("is_correct"))
    return found.select("run_id", F.lit("judge-a").alias("judge_model"), verdict.alias("verdict"))


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn"))
    return base.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")).alias("model_id"),
        F.col("conv_id").alias("prompt_id"),
        F.col("turn").alias("iteration_num"),
        ((F.col("role") == "assistant") & (F.col("turn") == 1)).alias("accepted"),
        (F.length("text") % 100 / 100).cast("double").alias("mean_score"),
        at.alias("created_at"),
    )


def list_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's words as truth, the next part's as prediction."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_brand", "p_type")).alias("words"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("words").alias("predicted"))
    return part.join(after, "p_partkey").select(F.col("p_partkey").alias("record_id"), F.col("words").alias("truth"), "predicted")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = chosen(F.col("o_orderstatus"), {"F": "done", "P": "running", "O": "pending"})
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.concat(F.lit("kind"), (F.col("o_custkey") % 3).cast("string")).alias("kind"),
        (F.col("o_custkey") % 50).alias("args"),
        status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("claimed_at"),
        F.col("o_totalprice").alias("price"),
    )


def field_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs, each of one of three fields."""
    return runs(spark, sf_dir).withColumn("field_name", F.concat(F.lit("f"), (F.col("record_id") % 3).cast("string")))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three fields' truths for a record, in a table of their own: raw text, a JSON string or a JSON list."""
    value = F.concat(F.lit("c"), (F.col("o_custkey") % 15).cast("string"))
    stored = F.when(F.col("o_custkey") % 3 == 0, value).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.concat(F.lit('["'), value, F.lit('"]')))
    field = F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string"))
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 2").alias("record_id"), field.alias("field_name"), stored.alias("value_json"))


#: The kind of value of each field of typed_runs.
KINDS = {"sector_name": "single_categorical", "region": "single_categorical", "countries": "list_categorical"}


def typed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs, each of a field with its kind of value: truth and predicted are lists, of one value for single ones; predicted is null without an answer."""
    found = runs(spark, sf_dir)
    at = F.col("record_id") % 3
    field = F.when(at == 0, "sector_name").when(at == 1, "region").otherwise("countries")
    other = lambda c: F.concat(F.lit("C"), (c % 4).cast("string"))
    truth = F.when(at == 2, F.array("truth", other(F.col("record_id")))).otherwise(F.array("truth"))
    answer = F.when(at == 2, F.array(other(F.col("k")), F.upper("predicted"))).otherwise(F.array("predicted"))
    return found.withColumns({"field_name": field, "predicted": F.when(F.col("predicted").isNotNull(), answer), "truth": truth})


def field_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt versions that were run: the models' own, but for m3, which has the shared ones (model_id null)."""
    ran = typed_runs(spark, sf_dir).select("field_name", "model_id", "version").distinct()
    own = ran.where("model_id <> 'm3'").withColumn("accepted", (F.col("version") + F.substring("model_id", 2, 1).cast("int")) % 3 != 0)
    shared = ran.where("model_id = 'm3'").withColumn("model_id", F.lit(None).cast("string")).withColumn("accepted", F.col("version") < 3)
    return own.unionByName(shared)


def field_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer's candidates by field, each from a parent version."""
    field = F.element_at(F.array(*[F.lit(f) for f in KINDS]), (F.col("prompt_id") % 3 + 1).cast("int"))
    return iterations(spark, sf_dir).withColumn("field_name", field).withColumn("parent_version", (F.col("prompt_id") % 4).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("title"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a parent each, but for some, by model."""
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.concat(F.lit("m"), (c % 4).cast("string")).alias("model_id"),
        c.alias("prompt_id"),
        (c % 5 + 1).cast("int").alias("version"),
        F.when((c % 7 != 0) & (c >= 4), c - 4).alias("parent_id"),
        (c % 3 != 0).alias("accepted"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as users create them, some with a slug that isn't valid; their config declares fields and criteria."""
    k = F.col("n_nationkey").cast("string")
    slug = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "-").otherwise(""), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))))
    config = F.concat(
        F.lit('{"fields":[{"name":"size_'), k, F.lit('","label":"Size","type":"number"},{"name":"land_'), k,
        F.lit('","description":"Land"}],"exclusion_criteria":[{"tag":"off_topic","question":"Is it on topic?"},{"tag":" ","question":"q"}]}'),
    )
    return table(spark, sf_dir, "nation").select("n_nationkey", slug.alias("slug"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "a nation").alias("description"), config.alias("config"))


#: The same tables in DuckDB's SQL, as common table expressions.
SQL = {
    "runs": """runs AS (
  SELECT *, CASE WHEN error IS NULL THEN CASE WHEN k % 10 < 7 THEN truth ELSE 'c' || CAST(k % 17 AS VARCHAR) END END AS predicted
  FROM (SELECT event_id AS run_id, event_id // 4 AS record_id, 'm' || CAST(event_id % 4 AS VARCHAR) AS model_id,
    CAST(user_id % 3 + 1 AS INTEGER) AS version, ts AS created_at, k,
    CASE event_type WHEN 'purchase' THEN 'hit' WHEN 'signup' THEN 'correct_abstain' WHEN 'view' THEN 'abstain_miss' WHEN 'click' THEN 'wrong' WHEN 'error' THEN 'hallucination' END AS outcome,
    event_type IN ('purchase', 'signup') AS is_correct, CAST(k AS DOUBLE) / 100.0::DOUBLE AS confidence,
    CASE WHEN k % 20 = 0 THEN 'simulated' END AS error, CAST(floor(value * 10) AS BIGINT) AS latency_ms, CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) / 200.0::DOUBLE END AS logprob_confidence,
    value / 1000 AS cost_usd, value / 100 AS co2e_grams,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS honesty_score,
    CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS excerpt_verified, 'c' || CAST(user_id % 15 AS VARCHAR) AS truth
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""",
    "prompt_versions": "prompt_versions AS (SELECT CAST(v AS INTEGER) AS version, v <> 2 AS accepted FROM range(1, 4) t(v))",
    "judgments": "judgments AS (SELECT run_id, 'judge-a' AS judge_model, CASE WHEN k % 8 = 0 THEN NOT is_correct ELSE is_correct END AS verdict FROM runs WHERE run_id % 3 <> 0)",
    "iterations": """iterations AS (SELECT 'm' || CAST(conv_id % 4 AS VARCHAR) AS model_id, conv_id AS prompt_id, turn AS iteration_num,
    (role = 'assistant' AND turn = 1) AS accepted, CAST(length(text) % 100 AS DOUBLE) / 100 AS mean_score,
    make_timestamp((1704067200 + conv_id * 3600 + turn) * 1000000) AS created_at FROM conversations)""",
    "list_pairs": """part_words AS (SELECT p_partkey, string_split(p_name, ' ') || [p_brand, p_type] AS words FROM part),
list_pairs AS (SELECT a.p_partkey AS record_id, a.words AS truth, b.words AS predicted FROM part_words a JOIN part_words b ON b.p_partkey = a.p_partkey + 1)""",
    "tasks": """tasks AS (SELECT o_orderkey AS task_id, 'kind' || CAST(o_custkey % 3 AS VARCHAR) AS kind, o_custkey % 50 AS args,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS claimed_at, o_totalprice AS price FROM orders)""",
    "field_runs": "field_runs AS (SELECT *, 'f' || CAST(record_id % 3 AS VARCHAR) AS field_name FROM runs)",
    "ground_truth": """ground_truth AS (SELECT o_orderkey // 2 AS record_id, 'f' || CAST(o_orderkey % 3 AS VARCHAR) AS field_name,
    CASE o_custkey % 3 WHEN 0 THEN v WHEN 1 THEN '"' || v || '"' ELSE '["' || v || '"]' END AS value_json FROM (SELECT *, 'c' || CAST(o_custkey % 15 AS VARCHAR) AS v FROM orders))""",
    "typed_runs": """typed_runs AS (SELECT * EXCLUDE (truth, predicted), CASE record_id % 3 WHEN 0 THEN 'sector_name' WHEN 1 THEN 'region' ELSE 'countries' END AS field_name,
    CASE WHEN record_id % 3 = 2 THEN [truth, 'C' || CAST(record_id % 4 AS VARCHAR)] ELSE [truth] END AS truth,
    CASE WHEN predicted IS NOT NULL THEN CASE WHEN record_id % 3 = 2 THEN ['C' || CAST(k % 4 AS VARCHAR), upper(predicted)] ELSE [predicted] END END AS predicted FROM runs)""",
    "field_prompts": """ran AS (SELECT DISTINCT field_name, model_id, version FROM typed_runs),
field_prompts AS (SELECT *, (version + CAST(model_id[2] AS INTEGER)) % 3 <> 0 AS accepted FROM ran WHERE model_id <> 'm3' UNION ALL SELECT field_name, NULL, version, version < 3 FROM ran WHERE model_id = 'm3')""",
    "field_iterations": "field_iterations AS (SELECT *, ['sector_name', 'region', 'countries'][prompt_id % 3 + 1] AS field_name, CAST(prompt_id % 4 AS INTEGER) AS parent_version FROM iterations)",
    "records": "records AS (SELECT c_custkey AS record_id, c_name AS title FROM customer)",
    "prompts": """prompts AS (SELECT DISTINCT 'm' || CAST(conv_id % 4 AS VARCHAR) AS model_id, conv_id AS prompt_id, CAST(conv_id % 5 + 1 AS INTEGER) AS version,
    CASE WHEN conv_id % 7 <> 0 AND conv_id >= 4 THEN conv_id - 4 END AS parent_id, conv_id % 3 <> 0 AS accepted FROM conversations)""",
    "projects": """projects AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '-' ELSE '' END || lower(replace(n_name, '_', '-')) AS slug, n_name AS name,
    CASE WHEN n_nationkey % 2 = 0 THEN 'a nation' END AS description FROM nation)""",
}


def sql(names: str, query: str) -> str:
    """query after the named tables' expressions."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query


def sql_and(names: str, query: str) -> str:
    """query, which goes on with expressions of its own, after the named tables' ones."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + ",\n" + query
