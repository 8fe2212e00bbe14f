"""Reports over gated models, judges' replies and a replayed prompt optimizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, reports, summaries
from ..sources import fixtures
from ..sources.fixtures import sql, sql_and
from .registry import query

KNOWN = "known AS (SELECT * FROM field_runs WHERE predicted IS NOT NULL)"
REPORT = KNOWN + ",\nreport AS (SELECT field_name, model_id, count(*) AS n, avg(CAST(truth = predicted AS DOUBLE)) AS accuracy, avg(CAST(truth = predicted AS DOUBLE)) >= 0.7::DOUBLE AS passes FROM known GROUP BY 1, 2 HAVING count(*) >= 5)"


def _report(spark, sf_dir):
    return reports.gate_report(fixtures.field_runs(spark, sf_dir), ["field_name", "model_id"], gate=0.7)


@query(sql_and("runs field_runs", REPORT + " SELECT field_name, model_id, n, accuracy, passes FROM report"))
def gate_report(spark, sf_dir):
    """Raw accuracy of all versions by field and model; the gate is a parameter. MET19 is typed_gate_report."""
    return _report(spark, sf_dir).select("field_name", "model_id", "n", "accuracy", "passes")


@query(sql_and("runs field_runs", REPORT + """, o AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY accuracy DESC) AS i, count(*) OVER (PARTITION BY field_name) AS c FROM report)
SELECT field_name, count(*) FILTER (WHERE passes) AS n_passing, count(*) AS n_models, max(accuracy) AS best, min(accuracy) AS worst, avg(accuracy) AS mean, max(CASE WHEN i = c // 2 + 1 THEN accuracy END) AS median FROM o GROUP BY 1"""))
def gate_report_by_field(spark, sf_dir):
    """A summary of raw accuracy over all versions, beside typed_gates_by_field."""
    return reports.gate_summary(_report(spark, sf_dir), "field_name")


@query(sql_and("runs field_runs", REPORT + " SELECT count(*) FILTER (WHERE passes) AS n_passing, count(*) AS n_pairs, CAST(floor(count(*) FILTER (WHERE passes) / count(*)::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) AS overall_pct FROM report"))
def passing_share(spark, sf_dir):
    """AGG26."""
    return reports.passing_share(_report(spark, sf_dir))


@query(sql("runs field_runs", "SELECT field_name, count(DISTINCT model_id) AS n_models, avg(CAST(is_correct AS DOUBLE)) AS mean_correct FROM field_runs WHERE predicted IS NOT NULL GROUP BY 1"))
def correctness_by_field(spark, sf_dir):
    """AGG16."""
    known = fixtures.field_runs(spark, sf_dir).where("predicted IS NOT NULL")
    return known.groupBy("field_name").agg(F.countDistinct("model_id").alias("n_models"), F.avg(F.col("is_correct").cast("double")).alias("mean_correct"))


@query(sql_and("runs field_runs", REPORT + ", s AS (SELECT model_id, count(*) AS runs, avg(score) AS mean_score FROM runs GROUP BY 1) SELECT s.model_id, runs, mean_score, accuracy, passes FROM s LEFT JOIN (SELECT * FROM report WHERE field_name = 'f0' AND passes) g ON s.model_id = g.model_id"))
def summaries_with_gates(spark, sf_dir):
    """JON12: models without a passed gate stay."""
    gates = _report(spark, sf_dir).where("field_name = 'f0' AND passes").select("model_id", "accuracy", "passes")
    found = summaries.model_summary(fixtures.runs(spark, sf_dir)).select("model_id", F.col("n").alias("runs"), "mean_score")
    return found.join(gates, "model_id", "left")


@query(sql_and("runs field_runs", KNOWN + """, a AS (SELECT model_id, avg(CAST(truth = predicted AS DOUBLE)) AS quality FROM known GROUP BY 1), c AS (SELECT model_id, sum(cost_usd) / count(*) * 1000 AS cost_per_1k FROM runs GROUP BY 1)
SELECT model_id, quality, cost_per_1k FROM a JOIN c USING (model_id)"""))
def cost_and_quality(spark, sf_dir):
    """UI7: the points of the leaderboard, best first."""
    runs = fixtures.runs(spark, sf_dir)
    cost = runs.groupBy("model_id").agg((F.sum("cost_usd") / F.count("*") * 1000).alias("cost_per_1k"))
    return reports.gate_report(runs, ["model_id"], 1).select("model_id", F.col("accuracy").alias("quality")).join(cost, "model_id").orderBy(F.desc_nulls_last("quality"), "model_id")


@query(sql_and("runs field_runs", KNOWN + """, a AS (SELECT model_id, avg(CAST(truth = predicted AS DOUBLE)) AS accuracy, count(*) AS n FROM known GROUP BY 1), c AS (SELECT model_id, sum(cost_usd) AS cost, sum(co2e_grams) AS co2e, count(error) AS n_errors FROM runs GROUP BY 1)
SELECT model_id, accuracy, accuracy >= 0.7::DOUBLE AS passes, cost / n AS cost_per_record, co2e / n AS co2e_per_record, n_errors FROM a JOIN c USING (model_id)"""))
def compared_models(spark, sf_dir):
    """MET18; the kappa beside it is covered by kappa_by_model."""
    return reports.compared_models(fixtures.runs(spark, sf_dir), 0.7).drop("kappa")


@query(sql_and("runs field_runs", KNOWN + """, w AS (SELECT truth, count(*) AS weight FROM runs GROUP BY 1), e AS (SELECT model_id, truth, avg(CAST(truth = predicted AS DOUBLE)) AS a FROM known WHERE k < 50 OR truth < 'c3' GROUP BY 1, 2)
SELECT model_id, sum(a * weight) / sum(weight) AS accuracy FROM e JOIN w USING (truth) GROUP BY 1"""))
def reweighted_accuracy(spark, sf_dir):
    """MET21."""
    runs = fixtures.runs(spark, sf_dir)
    return reports.reweighted(runs.where("predicted IS NOT NULL AND (k < 50 OR truth < 'c3')"), runs, "model_id")


@query(sql("runs", "SELECT model_id, coalesce(avg(v), 0) AS mean_verdict, count(v) AS n FROM (SELECT model_id, CASE WHEN model_id = 'm3' THEN NULL ELSE CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 END END::DOUBLE AS v FROM runs) GROUP BY 1"))
def judge_means(spark, sf_dir):
    """MET15: replies that can't be read don't count; of one model none can."""
    k = F.col("k") % 6
    raw = F.when(k == 0, '{"correct": true}').when(k == 1, '```json\n{"correct": false}\n```').when(k == 2, "no idea").when(k == 3, '{"verdict": 1}').when(k == 4, 'So: {"correct": 1}').otherwise('{"correct": null}')
    runs = fixtures.runs(spark, sf_dir)
    return reports.judge_mean(runs.withColumn("raw", F.when(F.col("model_id") != "m3", raw).otherwise("no")), "model_id", "raw")


@query(sql("runs", "SELECT model_id, version, avg(CASE WHEN error IS NULL THEN honesty_score ELSE 0 END) AS mean_score, count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS n_pairs, count(*) FILTER (WHERE error IS NULL AND is_correct) AS n_successes, count(*) FILTER (WHERE error IS NOT NULL OR NOT is_correct) AS n_failures FROM runs GROUP BY 1, 2"))
def evaluated_prompts(spark, sf_dir):
    """POL9."""
    return reports.evaluated(fixtures.runs(spark, sf_dir), ["model_id", "version"])


@query(sql_and("iterations", """c AS (SELECT model_id, prompt_id // 100 AS run, prompt_id AS step, iteration_num, mean_score, mean_score > 0.6::DOUBLE AND iteration_num < 3 AND mean_score * 0.9::DOUBLE >= 0.6::DOUBLE - 0.01::DOUBLE AS improves FROM iterations WHERE prompt_id % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY mean_score DESC, iteration_num) = 1),
b AS (SELECT s.*, iteration_num, mean_score, coalesce(improves, false) AS improves FROM (SELECT DISTINCT model_id, prompt_id // 100 AS run, prompt_id AS step FROM iterations) s LEFT JOIN c USING (model_id, run, step)),
i AS (SELECT *, row_number() OVER w AS place FROM b WINDOW w AS (PARTITION BY model_id, run ORDER BY step)),
m AS (SELECT *, place - 1 - coalesce(max(CASE WHEN improves THEN place END) OVER (PARTITION BY model_id, run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS misses FROM i),
s AS (SELECT *, NOT improves AND misses + 1 >= 4 AS stops FROM m), o AS (SELECT *, coalesce(max(stops) OVER (PARTITION BY model_id, run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM s)
SELECT model_id, run, step, iteration_num, mean_score, improves, misses, stops, misses >= 2 AS bold FROM o WHERE NOT past"""))
def replayed_optimizer(spark, sf_dir):
    """POL6: best candidate of each step, accepted by gate, floor and held-out score; steps without candidates, bold ones, and the stop after four rejections in a row."""
    run = ["model_id", "run"]
    tried = fixtures.iterations(spark, sf_dir).select("model_id", F.expr("prompt_id div 100").alias("run"), F.col("prompt_id").alias("step"), "iteration_num", "mean_score")
    judged = tried.where("step % 7 <> 3").withColumns({"val_score": F.col("mean_score"), "best_score": F.lit(0.59), "floor_ok": F.col("iteration_num") < 3, "holdout_score": F.col("mean_score") * 0.9, "holdout_best": F.lit(0.6)})
    accepted = gates.accepts(judged, F.lit(gates.EPSILON)).withColumnRenamed("accepted", "improves")
    best = reports.with_all_steps(reports.best_candidates(accepted, run, "step", "iteration_num"), tried, run, "step")
    return reports.replayed(best, run, "step")


@query(sql_and("runs", """r AS (SELECT record_id, event_id % 2 AS reflector, event_id % 4 // 2 + 1 AS attempt, CASE WHEN k % 3 = 0 THEN 'v' || CAST(k AS VARCHAR) END AS revised FROM (SELECT record_id, run_id AS event_id, k FROM runs))
SELECT record_id, revised, reflector, attempt FROM r WHERE revised IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY reflector, attempt) = 1"""))
def revision_proposals(spark, sf_dir):
    """POL11: the first readable reply in the order of reflectors and attempts; the ladder of temperatures belongs to live calls."""
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit('Here: {"instruction": " v'), F.col("k").cast("string"), F.lit('"}'))).when(F.col("k") % 3 == 1, "sorry").otherwise('{"instruction": "  "}')
    replies = fixtures.runs(spark, sf_dir).select("record_id", (F.col("run_id") % 2).alias("reflector"), F.expr("run_id % 4 div 2 + 1").alias("attempt"), raw.alias("raw"))
    return reports.proposals(replies, ["record_id"], "instruction")
