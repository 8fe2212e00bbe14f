"""Prompt texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import prompts
from ..sources import fixtures
from ..sources.fixtures import sql_and
from .registry import query

FIELDS = "field_name string, description string, kind string, allowed string, options array<string>, max_chars int"
SPECS = [
    ("sector", "Name the sector.", "single_categorical", "sectors", None, None),
    ("sub_sector", "Name the sub-sector.", "single_categorical", "sub_sectors", None, 3000),
    ("authors", "List the authors.", "list", "none", None, 500),
    ("decision", "Decide.", "single_categorical", "flat", ["INCLUDE", "EXCLUDE"], None),
]


def _taxonomy(spark, sf_dir):
    region, nation = fixtures.table(spark, sf_dir, "region"), fixtures.table(spark, sf_dir, "nation")
    definition = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("where "), F.lower("r_name")))
    sectors = region.select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("sector"), definition.alias("definition"))
    subs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sector"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("sub"))
    return sectors, subs


@query("SELECT n_name AS sub, regexp_replace(lower(r_name), '[^a-z0-9_]', '', 'g') AS key, len(list(n_name) OVER (PARTITION BY r_name)) AS n_subs FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy_narrowing(spark, sf_dir):
    """JON15, STR21's narrowing: each sub-sector beside the block that its sector is narrowed to."""
    sectors, subs = _taxonomy(spark, sf_dir)
    _, narrowed = prompts.option_blocks(sectors, subs)
    n_subs = F.size(F.split("lines", "\n")) - 1
    return subs.withColumn("key", prompts.sector_key(F.col("sector"))).join(narrowed, "key").select("sub", "key", n_subs.cast("long").alias("n_subs"))


@query(f"""WITH defined AS (SELECT string_agg('  ' || r_name || CASE WHEN r_regionkey % 2 = 0 THEN ': where ' || lower(r_name) ELSE '' END, chr(10) ORDER BY r_regionkey) AS d FROM region),
subs AS (SELECT r_regionkey, r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS listed, string_agg('  ' || n_name || chr(10), '' ORDER BY n_nationkey) AS lines FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2),
grouped AS (SELECT string_agg('  ' || r_name || ': ' || listed, chr(10) ORDER BY r_regionkey) AS g FROM subs),
p AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS text, doc_id % 5 AS kind, CASE WHEN doc_id % 5 = 1 THEN r_name ELSE 'Atlantis' END AS context, lines
  FROM documents JOIN subs ON r_regionkey = (doc_id // 5) % 5),
u AS (SELECT doc_id, CASE kind WHEN 0 THEN 'sector' WHEN 1 THEN 'sub_sector' WHEN 2 THEN 'sub_sector' WHEN 3 THEN 'authors' ELSE 'decision' END AS field_name,
  'PAPER TITLE: ' || title || chr(10) || chr(10) || '<paper>' || chr(10) || substr(text, 1, CASE kind WHEN 1 THEN 3000 WHEN 2 THEN 3000 WHEN 3 THEN 500 ELSE 10000 END) || chr(10) || '</paper>' || chr(10)
  || CASE kind WHEN 0 THEN '{prompts.DEFINED}' || d || chr(10)
       WHEN 1 THEN '{prompts.NARROWED[0]}' || context || '!' || '{prompts.NARROWED[1]}' || lines WHEN 2 THEN '{prompts.GROUPED}' || g || chr(10)
       WHEN 3 THEN '' ELSE '{prompts.FLAT}INCLUDE, EXCLUDE' || chr(10) END
  || chr(10) || 'TASK: ' || CASE kind WHEN 0 THEN 'Name the sector.' WHEN 1 THEN 'Own words {{}}.' WHEN 2 THEN 'Name the sub-sector.' WHEN 3 THEN 'List the authors.' ELSE 'Decide.' END || chr(10)
  || CASE WHEN kind = 3 THEN '{prompts.CONTRACTS["list"]}' ELSE '{prompts.CONTRACTS["single_categorical"]}' END AS prompt FROM p, defined, grouped)
SELECT doc_id, field_name, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM u""")
def extraction_prompts(spark, sf_dir):
    """STR21, STR20: prompts with defined, narrowed, grouped, flat and no allowed values, within the field's budget."""
    kind, region = F.col("doc_id") % 5, fixtures.table(spark, sf_dir, "region")
    field = F.when(kind == 0, "sector").when(kind < 3, "sub_sector").when(kind == 3, "authors").otherwise("decision")
    docs = fixtures.table(spark, sf_dir, "documents").join(region, F.floor(F.col("doc_id") / 5) % 5 == F.col("r_regionkey"))
    papers = docs.select(
        "doc_id", field.alias("field_name"), F.col("source").alias("title"), "text",
        F.when(kind == 1, F.concat("r_name", F.lit("!"))).otherwise("Atlantis").alias("context_value"), F.when(kind == 1, "Own words {}.").alias("instruction"),
    )
    found = prompts.extraction_prompts(papers, spark.createDataFrame(SPECS, FIELDS), *_taxonomy(spark, sf_dir))
    return found.select("doc_id", "field_name", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(sql_and("runs typed_runs", """v AS (SELECT run_id, field_name, truth, predicted, k % 5 = 0 AND field_name <> 'countries' AS several FROM typed_runs)
SELECT run_id, 'Field: ' || field_name || ' (what it is)' || chr(10) || 'Predicted value: ' || CASE WHEN field_name = 'countries' THEN coalesce('["' || array_to_string(predicted, '", "') || '"]', 'null') ELSE coalesce('"' || predicted[1] || '"', 'null') END || chr(10)
  || CASE WHEN several THEN 'Ground truth value (ANY ONE of these is acceptable): ["' || truth[1] || '", "Jose"]' WHEN field_name = 'countries' THEN 'Ground truth value: ["' || array_to_string(truth, '", "') || '"]' ELSE 'Ground truth value: "' || truth[1] || '"' END
  || chr(10) || chr(10) || 'Is the predicted value correct?' AS prompt FROM v"""))
def judge_prompts(spark, sf_dir):
    """PRJ5: judges' questions about single values, values with alternatives, and lists, in the form in which values are shown."""
    runs = fixtures.typed_runs(spark, sf_dir)
    one = runs.where("field_name <> 'countries'").withColumns({c: F.get(c, F.lit(0)) for c in ("truth", "predicted")})
    truth = F.when(F.col("k") % 5 == 0, F.concat("truth", F.lit(" |  José"))).otherwise(F.col("truth"))
    one = one.withColumn("truth", text.display_fold(truth))
    ask = lambda *parts: prompts.judge_prompt(F.col("field_name"), F.lit("what it is"), *parts).alias("prompt")
    single = one.select("run_id", ask(prompts.json_value(F.col("predicted")), prompts.json_value(F.col("truth")), text.alternatives(F.col("truth"))))
    several = prompts.shown_lists(runs.where("field_name = 'countries'"), "predicted", "truth")
    listed = several.select("run_id", ask(F.coalesce(prompts.json_list(F.col("predicted")), F.lit("null")), prompts.json_list(F.col("truth"))))
    return single.unionByName(listed)


@query(sql_and("runs", """c AS (SELECT model_id, version, run_id, is_correct, '"' || predicted || '"' AS p, '"' || truth || '"' AS t, outcome, row_number() OVER (PARTITION BY model_id, version, is_correct ORDER BY run_id) AS r FROM runs WHERE predicted IS NOT NULL)
SELECT model_id, version, string_agg('- record ' || run_id || ': predicted=' || p || ', expected=' || t || ' (' || outcome || '); excerpt cited: null', chr(10) ORDER BY r) FILTER (WHERE NOT is_correct) AS failures,
  string_agg('- record ' || run_id || ': correctly produced ' || p || ' (expected ' || t || ')', chr(10) ORDER BY r) FILTER (WHERE is_correct) AS successes FROM c WHERE r <= 8 GROUP BY 1, 2"""))
def reflector_cases(spark, sf_dir):
    """PRJ5: the first failures and successes of each prompt version, as lines; eight of each are the feature."""
    runs = fixtures.runs(spark, sf_dir).where("predicted IS NOT NULL")
    cases = runs.select("model_id", "version", "run_id", "is_correct", prompts.json_value(F.col("predicted")).alias("predicted_json"), prompts.json_value(F.col("truth")).alias("truth_json"), F.col("outcome").alias("explanation"), F.lit(None).cast("string").alias("excerpt"))
    return prompts.case_lists(cases, ["model_id", "version"], "run_id")
