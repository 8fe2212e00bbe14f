"""Gates by the field's kind of value, held-out means, model comparison and field states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Z95_SHORT
from ..operators import gates, gating, sampling
from ..sources import fixtures
from ..sources.fixtures import sql_and
from .metric_queries import CONFUSION, KAPPA, REST, _wilson_sql
from .registry import query


def gate_sql(rows: str) -> str:
    """Expressions for gated (grp, field_name, ...) from rows' columns grp, field_name, run_id, truth and predicted (lists)."""
    return f"""single AS (SELECT grp AS model_id, truth[1] AS truth, predicted[1] AS predicted, run_id FROM {rows} WHERE field_name <> 'countries'),
{KAPPA.format(rows="single")},
{CONFUSION.format(rows="single")},
{REST},
folded AS (SELECT grp, list_transform(predicted, lambda x: lower(x)) AS p, list_transform(truth, lambda x: lower(x)) AS t FROM {rows} WHERE field_name = 'countries'),
hits AS (SELECT grp, len(p) AS np, len(t) AS nt, CAST(coalesce(list_sum(list_transform(list_distinct(p), lambda v: least(len(list_filter(p, lambda x: x = v)), len(list_filter(t, lambda x: x = v))))), 0) AS BIGINT) AS tp FROM folded),
micro AS (SELECT grp, count(*) AS n, coalesce(sum(tp) / nullif(sum(np), 0)::DOUBLE, 0) AS precision, coalesce(sum(tp) / nullif(sum(nt), 0)::DOUBLE, 0) AS recall FROM hits GROUP BY 1),
grps AS (SELECT DISTINCT grp, field_name FROM {rows}),
gated AS (
  SELECT grp, field_name, n, CASE WHEN field_name = 'sector_name' THEN 'kappa' ELSE 'accuracy' END AS metric_name, CASE WHEN field_name = 'sector_name' THEN kappa ELSE accuracy END AS metric,
    accuracy, kappa, sensitivity, NULL::DOUBLE AS recall, CASE WHEN sensitivity_gateable THEN sensitivity >= 0.7 ELSE true END AS floor_ok
  FROM grps JOIN kappa ON grp = kappa.model_id JOIN rest ON grp = rest.model_id
  UNION ALL SELECT grp, field_name, n, 'f1', coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), NULL, NULL, NULL, recall, recall >= 0.85 FROM grps JOIN micro USING (grp)
), gates AS (SELECT *, coalesce(metric >= CASE WHEN field_name = 'sector_name' THEN 0.8 ELSE 0.9 END, false) AND floor_ok AS passes FROM gated)"""


CURRENT = """own AS (SELECT field_name, model_id, max(version) AS own FROM field_prompts WHERE accepted AND model_id IS NOT NULL GROUP BY 1, 2),
shared AS (SELECT field_name, max(version) AS shared FROM field_prompts WHERE accepted AND model_id IS NULL GROUP BY 1),
current AS (SELECT m.field_name, m.model_id, coalesce(own, shared) AS version FROM (SELECT DISTINCT field_name, model_id FROM typed_runs) m LEFT JOIN own USING (field_name, model_id) LEFT JOIN shared USING (field_name) WHERE coalesce(own, shared) IS NOT NULL),
mine AS (SELECT t.*, t.field_name || '/' || t.model_id AS grp FROM typed_runs t SEMI JOIN current c ON t.field_name = c.field_name AND t.model_id = c.model_id AND t.version = c.version),
answered AS (SELECT * FROM mine WHERE predicted IS NOT NULL)"""


def _report(spark, sf_dir):
    return gating.gate_report(fixtures.typed_runs(spark, sf_dir), fixtures.field_prompts(spark, sf_dir), fixtures.KINDS)


REPORT = CURRENT + ",\n" + gate_sql("answered") + ",\nreport AS (SELECT *, string_split(grp, '/')[2] AS model_id FROM gates WHERE n >= 5)"


@query(sql_and("runs typed_runs field_prompts", REPORT + " SELECT field_name, model_id, n, metric_name, metric, accuracy, kappa, sensitivity, recall, floor_ok, passes FROM report"))
def typed_gate_report(spark, sf_dir):
    """MET19, MET7-MET9, WIN2: single fields by kappa or accuracy and lists by micro F1, on each model's version in force."""
    return _report(spark, sf_dir).select("field_name", "model_id", "n", "metric_name", "metric", "accuracy", "kappa", "sensitivity", "recall", "floor_ok", "passes")


@query(sql_and("runs typed_runs field_prompts", REPORT + """, o AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY metric DESC) AS i, count(metric) OVER (PARTITION BY field_name) AS c FROM report)
SELECT field_name, count(*) FILTER (WHERE passes) AS n_passing, count(*) AS n_models, max(metric) AS best, min(metric) AS worst, avg(metric) AS mean, max(CASE WHEN i = c // 2 + 1 THEN metric END) AS median FROM o GROUP BY 1"""))
def typed_gates_by_field(spark, sf_dir):
    """MET19's summary: models that pass, best, worst and upper middle metric of each field."""
    return gating.report_by_field(_report(spark, sf_dir))


@query(sql_and("runs typed_runs", """held AS (SELECT *, field_name || '/' || version || '/' || model_id AS grp FROM typed_runs WHERE error IS NULL AND record_id IN (
  SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY md5('5:' || CAST(record_id AS VARCHAR)), record_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT record_id FROM typed_runs)) WHERE i <= least(800, n // 3))),
""" + gate_sql("held") + " SELECT field_name, CAST(string_split(grp, '/')[2] AS INTEGER) AS version, avg(metric) AS holdout_metric, count(metric) AS n_models FROM gates GROUP BY 1, 2"))
def holdout_means(spark, sf_dir):
    """POL5, SMP2: per prompt version the mean over models of the gate metric on the held-out records; failed calls give no pair."""
    rows = fixtures.typed_runs(spark, sf_dir)
    parts = sampling.split(rows.select("record_id").distinct(), "record_id", 5, 800, 300)
    return gating.holdout_means(rows.where("error IS NULL"), parts.where("part = 'holdout'"), fixtures.KINDS)


@query(sql_and("runs typed_runs", "answered AS (SELECT *, field_name || '/' || model_id AS grp FROM typed_runs WHERE predicted IS NOT NULL),\n" + gate_sql("answered") + """,
spent AS (SELECT field_name || '/' || model_id AS grp, model_id, sum(cost_usd) AS cost, sum(co2e_grams) AS co2e, count(error) AS n_errors, greatest(1, count(predicted)) AS k FROM typed_runs GROUP BY ALL)
SELECT field_name, model_id, metric_name, metric, recall, floor_ok, passes, cost / k AS cost_per_record, co2e / k AS co2e_per_record, n_errors FROM spent JOIN gates USING (grp)"""))
def typed_compared_models(spark, sf_dir):
    """MET18, POL10: distilled models beside the others, by kind of field, with floors, cost and footprint."""
    return gating.compared_models(fixtures.typed_runs(spark, sf_dir), fixtures.KINDS)


STATES = CURRENT + ",\n" + gate_sql("answered") + """,
said AS (SELECT run_id, count(*) AS j, count(*) FILTER (WHERE verdict) AS r FROM judgments GROUP BY 1),
told AS (SELECT field_name, model_id, count(DISTINCT CASE WHEN error IS NULL THEN record_id END) AS refs, count(*) FILTER (WHERE predicted IS NOT NULL AND j IS NULL) AS unjudged,
  CAST(coalesce(sum(j), 0) AS BIGINT) AS n_judged, sum(r)::DOUBLE / sum(j) AS judged_accuracy FROM mine LEFT JOIN said USING (run_id) GROUP BY 1, 2),
tried AS (SELECT field_name, model_id, count(*) AS n_iterations, count(*) FILTER (WHERE last IS NULL OR created_at > last) AS since_accept, bool_or(NOT accepted AND parent_version = version) AS exhausted
  FROM (SELECT i.*, c.version, max(CASE WHEN accepted THEN created_at END) OVER (PARTITION BY i.field_name, i.model_id) AS last FROM field_iterations i LEFT JOIN current c ON i.field_name = c.field_name AND i.model_id = c.model_id) GROUP BY 1, 2),
states AS (SELECT c.field_name, c.model_id, c.version, coalesce(refs, 0) AS refs, coalesce(unjudged, 0) AS unjudged, coalesce(n_judged, 0) AS n_judged, judged_accuracy, metric, g.n AS n_gated, floor_ok, passes,
  coalesce(n_iterations, 0) AS n_iterations, coalesce(since_accept, 0) AS since_accept, coalesce(exhausted, false) AS exhausted
  FROM current c LEFT JOIN told USING (field_name, model_id) LEFT JOIN gates g ON g.grp = c.field_name || '/' || c.model_id LEFT JOIN tried t ON t.field_name = c.field_name AND t.model_id = c.model_id)"""


def _states(spark, sf_dir):
    tables = (fixtures.typed_runs(spark, sf_dir), fixtures.field_prompts(spark, sf_dir), fixtures.judgments(spark, sf_dir), fixtures.field_iterations(spark, sf_dir))
    return gating.model_states(*tables, fixtures.KINDS)


@query(sql_and("runs typed_runs field_prompts judgments iterations field_iterations", STATES + " SELECT * FROM states"))
def model_states(spark, sf_dir):
    """POL2: per field and model records, judges, gate, floor and optimizer on the version in force."""
    return _states(spark, sf_dir).select(
        "field_name", "model_id", "version", "refs", "unjudged", "n_judged", "judged_accuracy", "metric", "n_gated", "floor_ok", "passes", "n_iterations", "since_accept", "exhausted"
    )


@query(sql_and("runs typed_runs field_prompts judgments iterations field_iterations", STATES + """, policy AS (SELECT *, n_gated IS NOT NULL AND NOT coalesce(passes, false) AS below, CASE WHEN n_iterations >= 25 THEN 'budget'
    WHEN n_iterations >= 5 AND since_accept >= 3 THEN CASE WHEN CASE WHEN field_name = 'sector_name' THEN 0.8 ELSE 0.9 END - coalesce(metric, 0) > 0.05 THEN 'task_limited' ELSE 'plateaued' END ELSE 'optimize' END AS status FROM states),
f AS (SELECT field_name, min(refs) AS refs, CAST(sum(unjudged) AS BIGINT) AS unjudged, count(n_gated) AS n_evaluated, count(*) FILTER (WHERE below) AS n_below, count(*) FILTER (WHERE below AND status = 'optimize' AND NOT exhausted) AS n_optimizable,
  count(*) FILTER (WHERE below AND status <> 'optimize') AS n_flagged, coalesce(bool_or(passes), false) AS best_passes FROM policy GROUP BY 1)
SELECT *, CASE WHEN refs = 0 THEN 'extract' WHEN unjudged > 0 AND field_name <> 'region' THEN 'judge' WHEN n_evaluated = 0 THEN 'judge' WHEN n_optimizable > 0 THEN 'optimize' WHEN best_passes AND refs < 100 THEN 'extract'
  WHEN best_passes THEN 'done' WHEN n_flagged > 0 THEN 'review' ELSE 'stuck' END AS action FROM (SELECT * REPLACE (CASE WHEN field_name = 'region' THEN 0 ELSE unjudged END AS unjudged) FROM f)"""))
def field_actions(spark, sf_dir):
    """POL2, POL3: the state of each field and what to do next; judges of one field are taken as done, so that later steps are reached."""
    states = gating.field_states(_states(spark, sf_dir)).withColumn("unjudged", F.when(F.col("field_name") == "region", 0).otherwise(F.col("unjudged")).cast("long"))
    return gates.next_action(states)


@query(sql_and("runs typed_runs field_prompts", REPORT + """, best AS (SELECT field_name, max(metric) AS model, max_by(model_id, (metric, model_id)) AS model_id FROM report GROUP BY 1),
h AS (WITH second AS (SELECT field_name AS grp, field_name, run_id, truth, CASE WHEN k % 9 = 0 THEN ['other'] ELSE truth END AS predicted FROM typed_runs WHERE k % 4 <> 0),
""" + gate_sql("second") + f""" SELECT field_name, n, metric_name, metric AS human, metric AS p FROM gates),
b AS (SELECT *, {_wilson_sql(Z95_SHORT)} FROM h)
SELECT field_name, metric_name, human, n, low, high, model_id, model, CASE WHEN model IS NULL THEN 'no model runs' WHEN model >= low THEN 'model within human range' ELSE 'model below human' END AS verdict,
  CASE WHEN model < low THEN human - model END AS gap FROM b LEFT JOIN best USING (field_name)"""))
def human_agreement(spark, sf_dir):
    """MET17: a second reading against the truth by kind of field, its interval, and the best model beside it."""
    runs = fixtures.typed_runs(spark, sf_dir)
    second = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).when(F.col("k") % 9 == 0, F.array(F.lit("other"))).otherwise(F.col("truth"))
    return gating.human_agreement(runs.withColumn("predicted", second), fixtures.KINDS, _report(spark, sf_dir))
