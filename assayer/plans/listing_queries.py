"""Joins with truth and prompts, lists of projects and fields, splits, worked examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exemplars, models
from ..operators import listings, sampling, summaries, tables, versions
from ..sources import fixtures
from ..sources.fixtures import sql, sql_and
from .registry import query

DECODED = "CASE WHEN json_valid(value_json) THEN value_json::JSON ->> '$' ELSE value_json END"


@query(sql("runs field_runs ground_truth", f"SELECT run_id, model_id, r.record_id, r.field_name, predicted, {DECODED} AS value FROM field_runs r JOIN ground_truth g ON r.record_id = g.record_id AND r.field_name = g.field_name WHERE predicted IS NOT NULL"))
def runs_with_truth(spark, sf_dir):
    """JON1."""
    found = listings.with_truth(fixtures.field_runs(spark, sf_dir), fixtures.ground_truth(spark, sf_dir))
    return found.select("run_id", "model_id", "record_id", "field_name", "predicted", listings.decoded(F.col("value_json")).alias("value"))


@query(sql("ground_truth records", f"SELECT r.record_id, title, {DECODED} AS value FROM records r JOIN ground_truth g USING (record_id) WHERE field_name = 'f1'"))
def records_with_truth(spark, sf_dir):
    """JON2, JON17."""
    found = listings.records_with_truth(fixtures.records(spark, sf_dir), fixtures.ground_truth(spark, sf_dir), "f1")
    return found.select("record_id", "title", listings.decoded(F.col("value_json")).alias("value"))


@query(sql("runs", "SELECT 'all' AS requested, count(*) AS n FROM runs UNION ALL SELECT '2', count(*) FROM runs WHERE version = 2 UNION ALL SELECT '99', 0"))
def runs_by_request(spark, sf_dir):
    """FLT2: no version asked for, a known one, an unknown one."""
    runs, known = fixtures.runs(spark, sf_dir), fixtures.prompt_versions(spark)
    count = lambda asked: listings.of_version(runs, known, asked).agg(F.count("*").alias("n")).select(F.lit("all" if asked is None else str(asked)).alias("requested"), "n")
    return count(None).unionByName(count(2)).unionByName(count(99))


@query(sql("runs", "SELECT model_id, count(*) AS n FROM runs WHERE model_id IN ('m0', 'm2') AND version = 1 AND error IS NULL GROUP BY 1"))
def runs_of_tier(spark, sf_dir):
    """FLT4, FLT1: the models of a tier, composed with other conditions."""
    tier = [m for m, t in {"m0": "small", "m1": "large", "m2": "small"}.items() if t in ("small",)]
    return fixtures.runs(spark, sf_dir).where(F.col("model_id").isin(tier) & (F.col("version") == 1) & F.col("error").isNull()).groupBy("model_id").agg(F.count("*").alias("n"))


@query(sql("runs judgments", "SELECT j.run_id, verdict FROM judgments j WHERE run_id IN (SELECT run_id FROM runs WHERE model_id = 'm1' AND version = 3)"))
def judgments_of_runs(spark, sf_dir):
    """FLT8: judgments by the ids of runs found by several keys."""
    found = fixtures.runs(spark, sf_dir).where("model_id = 'm1' AND version = 3").select("run_id")
    return fixtures.judgments(spark, sf_dir).join(found, "run_id", "left_semi").select("run_id", "verdict")


@query(sql_and("iterations prompts", "gone AS (SELECT DISTINCT model_id, parent_id AS prompt_id FROM iterations JOIN (SELECT prompt_id, parent_id FROM prompts) USING (prompt_id) WHERE NOT accepted AND parent_id IS NOT NULL) SELECT p.model_id, p.prompt_id, g.prompt_id IS NOT NULL AS exhausted FROM prompts p LEFT JOIN gone g ON p.model_id = g.model_id AND p.prompt_id = g.prompt_id"))
def exhausted_prompts(spark, sf_dir):
    """JON9."""
    prompts = fixtures.prompts(spark, sf_dir)
    return listings.exhausted(prompts.select("model_id", "prompt_id"), fixtures.iterations(spark, sf_dir), prompts)


@query(sql("ground_truth records", "SELECT record_id, (SELECT value_json FROM ground_truth g WHERE g.record_id = r.record_id AND field_name = 'f1') AS stratum FROM records r WHERE (SELECT count(*) FROM ground_truth g WHERE g.record_id = r.record_id AND field_name IN ('f0', 'f1')) = 2"))
def complete_records_by_stratum(spark, sf_dir):
    """JON10."""
    return listings.complete_with_stratum(fixtures.records(spark, sf_dir), fixtures.ground_truth(spark, sf_dir), ["f0", "f1"], "f1").select("record_id", "stratum")


@query(sql_and("ground_truth records", """s AS (SELECT record_id, max(CASE WHEN field_name = 'f1' THEN value_json END) AS stratum FROM ground_truth WHERE field_name IN ('f0', 'f1') AND record_id IN (SELECT record_id FROM records) GROUP BY 1 HAVING count(*) = 2)
SELECT record_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('5:' || CAST(record_id AS VARCHAR)), record_id) AS t FROM s) ORDER BY t, stratum LIMIT 60"""))
def complete_case_sample(spark, sf_dir):
    """SMP7, WIN14: sampling is the feature."""
    whole = listings.complete_with_stratum(fixtures.records(spark, sf_dir), fixtures.ground_truth(spark, sf_dir), ["f0", "f1"], "f1")
    return sampling.round_robin(whole, "stratum", "record_id", 60, 5).select("record_id", "stratum")


@query(sql("ground_truth records", "SELECT record_id FROM records INTERSECT SELECT record_id FROM ground_truth WHERE field_name = 'f2'"))
def records_in_both(spark, sf_dir):
    """JON13."""
    return fixtures.records(spark, sf_dir).select("record_id").intersect(fixtures.ground_truth(spark, sf_dir).where("field_name = 'f2'").select("record_id"))


@query(sql("iterations prompts", "SELECT i.model_id, i.prompt_id, iteration_num, mean_score, i.accepted, version FROM iterations i JOIN prompts p ON i.prompt_id = p.prompt_id"))
def iterations_with_prompts(spark, sf_dir):
    """JON14."""
    return fixtures.iterations(spark, sf_dir).drop("created_at").join(fixtures.prompts(spark, sf_dir).select("prompt_id", "version"), "prompt_id").orderBy("iteration_num", "prompt_id")


@query(sql_and("projects", "own AS (SELECT 'nation-' || CAST(r_regionkey AS VARCHAR) AS slug, r_name AS name, NULL AS description FROM region) SELECT slug, name, coalesce(description, '') AS description FROM (SELECT * FROM own UNION ALL SELECT slug, name, description FROM projects WHERE slug NOT IN (SELECT slug FROM own))"))
def project_list(spark, sf_dir):
    """PRJ2."""
    own = fixtures.table(spark, sf_dir, "region").select(F.concat(F.lit("nation-"), F.col("r_regionkey").cast("string")).alias("slug"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return listings.projects(own, fixtures.projects(spark, sf_dir).select("slug", "name", "description"))


@query(sql("projects", "SELECT slug, 'size_' || CAST(n_nationkey AS VARCHAR) AS name, 'Size' AS label, 'number' AS type, '' AS description FROM projects UNION ALL SELECT slug, 'land_' || CAST(n_nationkey AS VARCHAR), 'land_' || CAST(n_nationkey AS VARCHAR), 'text', 'Land' FROM projects"))
def field_specs(spark, sf_dir):
    """PRJ1, PRJ4."""
    return listings.field_specs(fixtures.projects(spark, sf_dir))


@query(sql_and("projects", """ok AS (SELECT * FROM projects WHERE n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0),
wanted AS (SELECT slug, 'size_' || CAST(n_nationkey AS VARCHAR) AS field_name, '' AS template FROM ok UNION ALL SELECT slug, 'land_' || CAST(n_nationkey AS VARCHAR), 'Land' FROM ok UNION ALL SELECT slug, 'off_topic', 'Is it on topic?' FROM ok WHERE n_nationkey % 3 <> 0)
SELECT slug, field_name, template, 1 AS version FROM wanted"""))
def created_projects(spark, sf_dir):
    """SNK17: valid new slugs, and the first prompts they lack."""
    found = fixtures.projects(spark, sf_dir)
    new = listings.created(found, found.where("n_nationkey % 4 = 0"))
    there = found.where("n_nationkey % 3 = 0").select("slug", F.lit("off_topic").alias("field_name"))
    return listings.baseline_prompts(new, there).select("slug", "field_name", "template", "version")


@query(sql_and("prompts", """new AS (SELECT 'm' || CAST(k AS VARCHAR) AS model_id FROM range(6) t(k)),
last AS (SELECT model_id, max(version) AS v, first(prompt_id ORDER BY accepted DESC, version DESC, prompt_id DESC) AS parent FROM prompts GROUP BY 1)
SELECT model_id, coalesce(v, 0) + 1 AS version, parent AS parent_id, true AS accepted FROM new LEFT JOIN last USING (model_id)"""))
def added_prompts(spark, sf_dir):
    """SNK19, WIN6."""
    new = spark.range(6).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model_id"))
    return listings.add_versions(new, fixtures.prompts(spark, sf_dir))


@query(sql_and("runs field_runs", "f AS (SELECT record_id // 3 AS g, model_id, predicted FROM field_runs WHERE field_name = 'f0' AND predicted IS NOT NULL) SELECT run_id, predicted, context FROM (SELECT record_id // 3 AS g, model_id, run_id, predicted FROM field_runs WHERE field_name = 'f1') LEFT JOIN (SELECT g, model_id, predicted AS context FROM f) USING (g, model_id)"))
def two_step_runs(spark, sf_dir):
    """SRC16: the first field's answer is the second one's context."""
    runs = fixtures.field_runs(spark, sf_dir).withColumn("g", F.expr("record_id div 3"))
    return listings.two_step(runs.where("field_name = 'f0'"), runs.where("field_name = 'f1'"), ["g", "model_id"]).select("run_id", "predicted", "context")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price FROM part ORDER BY price DESC NULLS LAST, p_partkey")
def user_sorted(spark, sf_dir):
    """SRT4: nulls last though descending; the rows are those of the whole table, so only their order shows it (tests look at that)."""
    part = fixtures.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("price"))
    return part.orderBy(listings.user_order("price", True), "p_partkey")


@query("SELECT p_partkey, CAST(floor((p_partkey % 97) / 97.0::DOUBLE * 100) AS BIGINT) AS pct, CAST(floor(((p_partkey % 97) / 97.0::DOUBLE - (p_partkey % 89) / 89.0::DOUBLE) * 100 + 0.5::DOUBLE) AS BIGINT) AS delta FROM part")
def displayed_shares(spark, sf_dir):
    """MTH6."""
    at = lambda n: F.col("p_partkey") % n / n
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", listings.percent_floor(at(97)).alias("pct"), listings.delta_points(at(97), at(89)).alias("delta"))


@query("SELECT '/data/corpus/' || CAST(c_custkey AS VARCHAR) || '.md' AS md_path, c_custkey AS record_id FROM customer")
def corpus_paths(spark, sf_dir):
    """SNK14."""
    return fixtures.records(spark, sf_dir).select("record_id", listings.corpus_path("/data/corpus/", "record_id").alias("md_path"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') <> '' THEN CAST(contains(coalesce(text, ''), source) AS INTEGER) END AS stands FROM documents")
def screening_excerpts(spark, sf_dir):
    """STR18: the source's name stands for an excerpt."""
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", listings.excerpt_stands(F.col("source"), F.col("text")).alias("stands"))


DECISIONS = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' include' WHEN 1 THEN 'EXCLUDE on ' || c_mktsegment WHEN 2 THEN 'Exclude  On ' || c_mktsegment || '!' END AS decision FROM customer)"


def _decisions(spark, sf_dir):
    k, segment = F.col("c_custkey") % 4, F.col("c_mktsegment")
    said = F.when(k == 0, " include").when(k == 1, F.concat(F.lit("EXCLUDE on "), segment)).when(k == 2, F.concat(F.lit("Exclude  On "), segment, F.lit("!")))
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", said.alias("decision"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE upper(trim(decision)) LIKE 'INCLUDE%') AS n_include, count(*) FILTER (WHERE upper(trim(decision)) LIKE 'EXCLUDE%') AS n_exclude FROM {DECISIONS}")
def decision_counts(spark, sf_dir):
    """AGG24."""
    return listings.decision_counts(_decisions(spark, sf_dir), "decision")


@query(f"SELECT trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS tag, first(label ORDER BY c_custkey) AS label, count(*) AS n FROM (SELECT c_custkey, trim(substr(trim(decision), 8)) AS label FROM {DECISIONS} WHERE upper(trim(decision)) LIKE 'EXCLUDE%') GROUP BY 1")
def exclusion_tags(spark, sf_dir):
    """AGG24, GTQ7."""
    return listings.tag_counts(_decisions(spark, sf_dir), "decision", "c_custkey")


RANKED = "r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('{seed}:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS i, count(*) OVER () AS n FROM part)"


@query("WITH " + RANKED.format(seed=11) + " SELECT p_partkey, CASE WHEN i <= floor(n * 0.15::DOUBLE) THEN 'test' WHEN i <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r")
def fraction_splits(spark, sf_dir):
    """SMP3."""
    return sampling.split_fractions(fixtures.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 11, 0.15, 0.1)


@query("WITH " + RANKED.format(seed=12) + " SELECT p_partkey, CASE WHEN n > 10 AND i <= greatest(1, floor(n * 0.13::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM r")
def validation_split(spark, sf_dir):
    """SMP4."""
    return sampling.split_validation(fixtures.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 12, 0.13)


@query("WITH " + RANKED.format(seed=11) + """, s AS (SELECT p_partkey, CASE WHEN i <= floor(n * 0.15::DOUBLE) THEN 'test' WHEN i <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r)
SELECT '{"part":"' || part || '","n":' || count(*) || ',"first":' || min(p_partkey) || ',"last":' || max(p_partkey) || '}' AS manifest FROM s GROUP BY part""")
def split_manifest(spark, sf_dir):
    """SNK12: a manifest's line for each part."""
    parts = sampling.split_fractions(fixtures.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 11, 0.15, 0.1)
    told = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    return told.select(F.to_json(F.struct("part", "n", "first", "last")).alias("manifest"))


@query("""SELECT p_partkey, 'Pick one.' || CASE WHEN p_size % 5 = 0 THEN '  ' ELSE '' END AS base, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || '|' || p_brand || ';' || p_type || '|' || p_brand END AS examples FROM part""")
def parsed_exemplars(spark, sf_dir):
    """STR27: prompts written with two examples, or none, and parsed again."""
    part = fixtures.table(spark, sf_dir, "part")
    pairs = F.array(exemplars.example(F.col("p_name"), F.col("p_brand")), exemplars.example(F.col("p_type"), F.col("p_brand")))
    given = F.when(F.col("p_size") % 5 == 0, F.filter(pairs, lambda x: F.lit(False))).otherwise(pairs)
    written = part.select("p_partkey", exemplars.serialise(F.lit("Pick one.  "), given).alias("prompt"))
    return written.select("p_partkey", exemplars.base(F.col("prompt")).alias("base"), exemplars.joined(exemplars.parse(F.col("prompt"))).alias("examples"))


@query("""SELECT p_partkey, p_name || '|' || p_brand || ';' || p_type || '|' || p_brand || ';' || 'n1|a;n2|a;n3|a;n4|a' AS examples FROM part""")
def merged_exemplars(spark, sf_dir):
    """SET1, STR30: two kept; of those proposed one is known, one has no legal answer, one no paper, and the seventh is too many."""
    pair = lambda paper, answer: exemplars.example(paper if not isinstance(paper, str) else F.lit(paper), answer if not isinstance(answer, str) else F.lit(answer))
    kept = F.array(pair(F.col("p_name"), F.col("p_brand")), pair(F.col("p_type"), F.col("p_brand")))
    proposed = F.array(pair(F.concat(F.lit(" "), F.upper("p_name")), F.col("p_brand")), pair("odd", "nowhere"), pair("  ", "a"), *[pair(f"n{i}\n", "a") for i in range(1, 6)])
    checked = exemplars.legal(proposed, F.array(F.lit("a"), F.lower("p_brand")))
    part = tables.spread(fixtures.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"))
    return part.select("p_partkey", exemplars.joined(exemplars.merge(kept, checked)).alias("examples"))


NAMES = ["lab/GPT-mini-1", "lab/claude-opus-9", "lab/deepseek-v4-pro", "lab/deepseek-r", "anthropic/other", "lab/unheard-of"]


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 300 WHEN 2 THEN 37 WHEN 3 THEN 37 WHEN 4 THEN 8 ELSE 8 END::DOUBLE AS active, CASE c_custkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 300 WHEN 2 THEN 671 WHEN 3 THEN 671 ELSE 70 END::DOUBLE AS total,
CASE WHEN c_custkey % 6 IN (1, 4) THEN 'judge-b' ELSE 'judge-a' END AS judge FROM customer""")
def model_traits(spark, sf_dir):
    """MTH4 (the look-up of parameters), MET14."""
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("c_custkey") % 6 + 1).cast("int"))
    size = models.parameters(name)
    return fixtures.table(spark, sf_dir, "customer").select("c_custkey", size["active"].alias("active"), size["total"].alias("total"), models.judge_of_other_family(name, ["anthropic", "claude"], "judge-a", "judge-b").alias("judge"))


@query(sql("prompts", "SELECT model_id, count(*) AS total, count(*) FILTER (WHERE accepted AND version > 1) AS n_improvements FROM prompts GROUP BY 1"))
def improvement_counts(spark, sf_dir):
    """AGG7: the first version is no improvement."""
    return fixtures.prompts(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("total"), F.count_if(F.col("accepted") & (F.col("version") > 1)).alias("n_improvements"))


@query(sql("runs prompt_versions", "SELECT version, accepted, count(*) AS n_runs, count(DISTINCT model_id) AS n_models FROM runs JOIN prompt_versions USING (version) WHERE model_id = 'm0' OR version < 3 GROUP BY ALL HAVING count(DISTINCT model_id) >= 2"))
def compared_versions(spark, sf_dir):
    """UI6: versions that two models or more were run with."""
    runs = fixtures.runs(spark, sf_dir).where("model_id = 'm0' OR version < 3")
    return summaries.run_versions(runs, fixtures.prompt_versions(spark)).where("n_models >= 2")


@query(sql_and("runs typed_runs", "v AS (SELECT record_id // 2 AS g, model_id, predicted[1] AS prior, run_id FROM typed_runs WHERE predicted IS NOT NULL) SELECT g AS record_id, model_id, prior FROM v QUALIFY row_number() OVER (PARTITION BY g, model_id ORDER BY run_id DESC) = 1"))
def prior_values(spark, sf_dir):
    """WIN4: the latest answer of a model to a record, of lists their first value; two records are taken as one, so that there are several."""
    runs = fixtures.typed_runs(spark, sf_dir).where("predicted IS NOT NULL").withColumn("record_id", F.expr("record_id div 2"))
    return versions.latest(runs, ["record_id", "model_id"], ["run_id"], ["predicted"]).select("record_id", "model_id", F.get("predicted", F.lit(0)).alias("prior"))


@query(sql("prompts", "SELECT model_id, string_agg(version || ':' || prompt_id || CASE WHEN accepted THEN '+' ELSE '' END, ' ' ORDER BY version, prompt_id) AS listed FROM prompts GROUP BY 1"))
def prompt_list(spark, sf_dir):
    """PRJ3: a model's prompt versions in the order of their numbers."""
    line = F.concat(F.col("version").cast("string"), F.lit(":"), F.col("prompt_id").cast("string"), F.when(F.col("accepted"), "+").otherwise(""))
    found = fixtures.prompts(spark, sf_dir).groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("version", "prompt_id", line.alias("line")))).alias("p"))
    return found.select("model_id", F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("listed"))


@query(sql("projects", "SELECT n_nationkey, slug FROM projects WHERE n_nationkey IN (SELECT r_regionkey * 3 FROM region) OR slug = 'nation-7'"))
def projects_asked_for(spark, sf_dir):
    """FLT8: projects by their ids, some of which don't exist, and one by its slug."""
    found = fixtures.projects(spark, sf_dir).select("n_nationkey", "slug")
    ids = fixtures.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 3).alias("n_nationkey"))
    return listings.with_ids(found, ids, "n_nationkey").unionByName(listings.by_slug(found, "nation-7")).distinct()
