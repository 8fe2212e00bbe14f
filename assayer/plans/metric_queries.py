"""Metrics, gates and summaries of the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Z95, Z95_SHORT, T
from ..operators import gates, metrics, summaries, versions
from ..sources import fixtures
from ..sources.fixtures import sql, sql_and
from .registry import query

BEST = """best AS (SELECT model_id, version, accepted, n_runs FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY accepted DESC, CASE WHEN accepted THEN version END DESC NULLS LAST, n_runs DESC, version DESC) AS rank
  FROM (SELECT model_id, version, accepted, count(*) AS n_runs FROM runs JOIN prompt_versions USING (version) GROUP BY ALL)) WHERE rank = 1),
chosen AS (SELECT r.* FROM runs r SEMI JOIN best b ON r.model_id = b.model_id AND r.version = b.version)"""

KAPPA = """cells AS (SELECT model_id, truth, coalesce(predicted, '') AS predicted, count(*) AS n FROM {rows} WHERE truth IS NOT NULL GROUP BY ALL),
met AS (SELECT model_id, sum(CAST(t.n AS DOUBLE) * p.n) AS met FROM (SELECT model_id, truth AS label, sum(n) AS n FROM cells GROUP BY ALL) t
  JOIN (SELECT model_id, predicted AS label, sum(n) AS n FROM cells GROUP BY ALL) p USING (model_id, label) GROUP BY model_id),
agreed AS (SELECT model_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS DOUBLE) AS a FROM cells GROUP BY model_id),
kappa AS (SELECT model_id, n, a / n AS accuracy, (a / n - met / (CAST(n AS DOUBLE) * n)) / nullif(1 - met / (CAST(n AS DOUBLE) * n), 0) AS kappa FROM agreed JOIN met USING (model_id))"""

CONFUSION = """tops AS (SELECT model_id, truth AS label FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, seen) AS rank
  FROM (SELECT model_id, truth, count(*) AS n, min(run_id) AS seen FROM {rows} GROUP BY ALL)) WHERE rank <= 12),
confusion AS (SELECT r.model_id, coalesce(t.label, '(other)') AS truth_label,
  CASE WHEN r.predicted IS NULL THEN '(none)' ELSE coalesce(p.label, '(other)') END AS predicted_label, count(*) AS n
  FROM {rows} r LEFT JOIN tops t ON r.model_id = t.model_id AND r.truth = t.label LEFT JOIN tops p ON r.model_id = p.model_id AND r.predicted = p.label GROUP BY ALL)"""

REST = """counted AS (SELECT *, sum(in_truth) OVER (PARTITION BY model_id) AS total, coalesce(p, 0) AS in_predicted FROM
  (SELECT model_id, truth_label AS label, sum(n) AS in_truth, sum(CASE WHEN truth_label = predicted_label THEN n ELSE 0 END) AS tp FROM confusion GROUP BY ALL)
  LEFT JOIN (SELECT model_id, predicted_label AS label, sum(n) AS p FROM confusion GROUP BY ALL) USING (model_id, label)),
rates AS (SELECT *, CAST(tp AS DOUBLE) / in_truth AS sens, coalesce((total - in_truth - in_predicted + tp)::DOUBLE / nullif(total - in_truth, 0), 0) AS spec,
  coalesce(tp::DOUBLE / nullif(in_predicted, 0), 0) AS prec FROM counted),
rest AS (SELECT model_id, avg(sens) AS sensitivity, avg(spec) AS specificity, avg(coalesce(5 * prec * sens / nullif(4 * prec + sens, 0), 0)) AS f2,
  count(*) FILTER (WHERE label <> '(other)' AND in_truth < 5) AS n_undersampled,
  count(*) FILTER (WHERE label <> '(other)' AND in_truth < 5) = 0 AND count(*) FILTER (WHERE label <> '(other)') >= 2 AS sensitivity_gateable FROM rates GROUP BY model_id)"""

OPTIMIZER = """stats AS (SELECT model_id, count(*) AS n_candidates, count(*) FILTER (WHERE accepted) AS n_accepted,
  count(*) FILTER (WHERE last IS NULL OR created_at > last) AS since_accept
  FROM (SELECT *, max(CASE WHEN accepted THEN created_at END) OVER (PARTITION BY model_id) AS last FROM iterations) GROUP BY model_id)"""
JUDGED = """judged AS (SELECT model_id, count(*) AS n_judged, avg(CAST(verdict AS DOUBLE)) AS judged_accuracy FROM judgments j JOIN {rows} r ON j.run_id = r.run_id GROUP BY model_id)"""


def of(spark, sf_dir):
    return versions.of_best_version(fixtures.runs(spark, sf_dir), fixtures.prompt_versions(spark))


@query(
    sql(
        "runs",
        """SELECT model_id, count(*) AS n, avg(score) AS mean_score, avg(honesty_score) AS mean_honesty, avg(logprob_confidence) AS mean_logprob, avg(latency_ms) AS mean_latency_ms,
  count(*) FILTER (WHERE is_correct)::DOUBLE / count(*) AS accuracy, count(*) FILTER (WHERE outcome = 'hallucination')::DOUBLE / count(*) AS hallucination_rate,
  count(*) FILTER (WHERE outcome IN ('abstain_miss', 'correct_abstain'))::DOUBLE / count(*) AS abstention_rate, count(error)::DOUBLE / count(*) AS error_rate,
  count(*) FILTER (WHERE excerpt_verified)::DOUBLE / nullif(count(excerpt_verified), 0) AS excerpt_verified_rate, sum(cost_usd) AS total_cost_usd,
  sum(co2e_grams) AS total_co2e_grams, max(version) AS latest_version FROM runs GROUP BY model_id""",
    )
)
def model_summary(spark, sf_dir):
    """AGG1, AGG2, FLT5."""
    return summaries.model_summary(fixtures.runs(spark, sf_dir))


@query(sql("runs prompt_versions", "SELECT version, accepted, count(*) AS n_runs, count(DISTINCT model_id) AS n_models FROM runs JOIN prompt_versions USING (version) GROUP BY ALL"))
def run_versions(spark, sf_dir):
    """AGG3, JON3."""
    return summaries.run_versions(fixtures.runs(spark, sf_dir), fixtures.prompt_versions(spark))


@query(sql_and("runs prompt_versions", BEST + " SELECT model_id, version, accepted, n_runs FROM best"))
def best_version(spark, sf_dir):
    """WIN1, WIN2."""
    runs = fixtures.runs(spark, sf_dir)
    return versions.best_version(runs, fixtures.prompt_versions(spark))


@query(sql_and("runs prompt_versions", BEST + " SELECT model_id, count(*) AS n, count(DISTINCT record_id) AS n_records, avg(score) AS mean_score FROM chosen GROUP BY model_id"))
def best_version_runs(spark, sf_dir):
    """FLT3, AGG6."""
    return of(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"), F.avg("score").alias("mean_score"))


@query(sql_and("runs", KAPPA.format(rows="runs") + " SELECT model_id, n, accuracy, kappa FROM kappa"))
def kappa_by_model(spark, sf_dir):
    """MET1, MET3."""
    return metrics.kappa(fixtures.runs(spark, sf_dir), ["model_id"])


@query(sql_and("runs", CONFUSION.format(rows="runs") + " SELECT model_id, truth_label, predicted_label, n FROM confusion"))
def confusion_cells(spark, sf_dir):
    """MET2."""
    return metrics.confusion_cells(fixtures.runs(spark, sf_dir), ["model_id"], "run_id")


@query(sql_and("runs", CONFUSION.format(rows="runs") + ",\n" + REST + " SELECT * FROM rest"))
def one_vs_rest(spark, sf_dir):
    """MET4, MET5, MTH1."""
    return metrics.one_vs_rest(metrics.confusion_cells(fixtures.runs(spark, sf_dir), ["model_id"], "run_id"), ["model_id"])


@query(
    sql_and(
        "list_pairs",
        """folded AS (SELECT list_transform(predicted, lambda x: lower(x)) AS predicted, list_transform(truth, lambda x: lower(x)) AS truth FROM list_pairs),
counted AS (SELECT CAST(coalesce(list_sum(list_transform(list_distinct(predicted), lambda v: least(len(list_filter(predicted, lambda x: x = v)), len(list_filter(truth, lambda x: x = v))))), 0) AS BIGINT) AS tp,
  len(predicted) AS p, len(truth) AS t, 5000 - len(list_distinct(truth)) AS neg FROM folded),
total AS (SELECT count(*) AS n, sum(tp)::BIGINT AS tp, sum(p - tp)::BIGINT AS fp, sum(t - tp)::BIGINT AS fn, sum(greatest(0, neg - (p - tp)))::BIGINT AS tn FROM counted),
rates AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM total)
SELECT n, tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall) AS f1, 5 * precision * recall / (4 * precision + recall) AS f2, tn::DOUBLE / (tn + fp) AS specificity FROM rates""",
    )
)
def list_overlap(spark, sf_dir):
    """ARR1, MET6."""
    return metrics.list_metrics(fixtures.list_pairs(spark, sf_dir), [], 5000)


@query(
    sql_and(
        "runs",
        """known AS (SELECT model_id, confidence, CAST(is_correct AS DOUBLE) AS r, least(CAST(floor(confidence * 5) AS INTEGER), 4) AS bin FROM runs),
brier AS (SELECT model_id, avg((confidence - r) * (confidence - r)) AS brier FROM known GROUP BY 1),
filled AS (SELECT model_id, bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(r) AS accuracy FROM known GROUP BY 1, 2)
SELECT model_id, brier, bin, coalesce(n, 0) AS n, mean_confidence, accuracy FROM (SELECT model_id, brier, CAST(b AS INTEGER) AS bin FROM brier, range(5) t(b)) LEFT JOIN filled USING (model_id, bin)""",
    )
)
def calibration(spark, sf_dir):
    """MET10."""
    return metrics.calibration_bins(fixtures.runs(spark, sf_dir), ["model_id"])


@query(
    sql_and(
        "runs",
        """known AS (SELECT model_id, CAST(is_correct AS DOUBLE) AS r, least(CAST(floor(confidence * 5) AS INTEGER), 4) AS bin FROM runs),
bins AS (SELECT model_id, bin, count(*) AS n, avg(r) AS accuracy FROM known GROUP BY 1, 2),
summed AS (SELECT model_id, bin, sum(n) OVER w AS upto, sum(n * accuracy) OVER w AS r, sum(n) OVER (PARTITION BY model_id) AS whole FROM bins WINDOW w AS (PARTITION BY model_id ORDER BY bin DESC))
SELECT model_id, bin, round(100.0::DOUBLE * upto / whole, 1) AS share_pct, round(100.0::DOUBLE * r / upto, 1) AS accuracy_pct FROM summed""",
    )
)
def work_saved(spark, sf_dir):
    """UI1, WIN11."""
    return metrics.work_saved(metrics.calibration_bins(fixtures.runs(spark, sf_dir), ["model_id"]), ["model_id"])


@query()
def work_saved_at_target(spark, sf_dir):
    """UI2."""
    curve = metrics.work_saved(metrics.calibration_bins(fixtures.runs(spark, sf_dir), ["model_id"]), ["model_id"])
    return metrics.share_at(curve, ["model_id"], 40.0)


@query(
    sql_and(
        "runs",
        """points AS (SELECT model_id, confidence, count(*) AS n, count(*) FILTER (WHERE is_correct) AS r FROM runs WHERE confidence IS NOT NULL GROUP BY 1, 2)
SELECT model_id, confidence, sum(n) OVER w / sum(n) OVER (PARTITION BY model_id)::DOUBLE AS share, sum(r) OVER w::DOUBLE / sum(n) OVER w AS accuracy FROM points WINDOW w AS (PARTITION BY model_id ORDER BY confidence DESC)""",
    )
)
def work_saved_exact(spark, sf_dir):
    """UI3."""
    return metrics.work_saved_exact(fixtures.runs(spark, sf_dir), ["model_id"])


@query(
    sql_and(
        "runs",
        """answers AS (SELECT record_id, model_id, max_by(predicted, (created_at, run_id)) AS value FROM runs WHERE error IS NULL AND predicted IS NOT NULL GROUP BY 1, 2),
share AS (SELECT a.record_id, a.model_id, avg(CASE WHEN a.value = b.value THEN 1.0 ELSE 0.0 END) AS share FROM answers a JOIN answers b ON a.record_id = b.record_id AND a.model_id <> b.model_id GROUP BY 1, 2)
SELECT model_id, avg(share) AS agreement, count(*) AS n_records FROM share GROUP BY 1""",
    )
)
def cross_model_agreement(spark, sf_dir):
    """MET11, JON11, WIN5, FLT7."""
    known = fixtures.runs(spark, sf_dir).where("error IS NULL AND predicted IS NOT NULL")
    answers = versions.latest(known.withColumn("value", F.col("predicted")), ["record_id", "model_id"], ["created_at", "run_id"], ["value"])
    return metrics.agreement(answers)


@query(
    sql_and(
        "runs judgments",
        """scored AS (SELECT r.confidence AS s, j.verdict AS t FROM runs r JOIN judgments j USING (run_id) WHERE r.confidence IS NOT NULL),
met AS (SELECT round(0.5 + i * 0.05, 2)::DOUBLE AS threshold, count(*) FILTER (WHERE s >= round(0.5 + i * 0.05, 2)::DOUBLE AND t) AS tp, count(*) FILTER (WHERE s >= round(0.5 + i * 0.05, 2)::DOUBLE AND NOT t) AS fp,
  count(*) FILTER (WHERE s < round(0.5 + i * 0.05, 2)::DOUBLE AND t) AS fn FROM scored, range(11) r(i) GROUP BY i),
rates AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM met)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates""",
    )
)
def judge_threshold_sweep(spark, sf_dir):
    """MET13."""
    scored = fixtures.runs(spark, sf_dir).select("run_id", "confidence").join(fixtures.judgments(spark, sf_dir), "run_id")
    return metrics.threshold_sweep(scored.where("confidence IS NOT NULL"), "confidence", "verdict")


@query(sql_and("runs judgments", JUDGED.format(rows="runs") + " SELECT * FROM judged"))
def judge_summary(spark, sf_dir):
    """AGG4, JON5."""
    return summaries.judge_summary(fixtures.judgments(spark, sf_dir), fixtures.runs(spark, sf_dir))


@query(sql_and("iterations", OPTIMIZER + " SELECT * FROM stats"))
def optimizer_stats(spark, sf_dir):
    """AGG8, WIN7, UI8."""
    return summaries.optimizer_stats(fixtures.iterations(spark, sf_dir))


@query(
    sql_and(
        "runs prompt_versions judgments iterations",
        BEST + ",\n" + KAPPA.format(rows="chosen") + ",\n" + CONFUSION.format(rows="chosen") + ",\n" + REST + ",\n" + OPTIMIZER + ",\n" + JUDGED.format(rows="chosen")
        + """,
gated AS (SELECT *, coalesce(kappa >= 0.8, false) AND CASE WHEN sensitivity_gateable THEN sensitivity >= 0.7 ELSE true END AS clears FROM kappa JOIN rest USING (model_id) LEFT JOIN judged USING (model_id) LEFT JOIN stats USING (model_id)),
flags AS (SELECT *, clears AND coalesce(kappa - judged_accuracy > 0.1, false) AS judge_disagreement FROM gated)
SELECT model_id, n, accuracy, kappa, sensitivity, specificity, f2, n_undersampled, sensitivity_gateable, judged_accuracy, coalesce(n_judged, 0) AS n_judged,
  clears AND NOT judge_disagreement AS gate_passed, judge_disagreement,
  CASE WHEN clears AND NOT judge_disagreement THEN 'passed' WHEN coalesce(n_candidates, 0) >= 25 THEN 'budget'
    WHEN coalesce(n_candidates, 0) >= 5 AND coalesce(since_accept, 0) >= 3 THEN CASE WHEN 0.8 - coalesce(kappa, 0) > 0.05 THEN 'task_limited' ELSE 'plateaued' END ELSE 'optimize' END AS opt_status,
  coalesce(n_candidates, 0) AS n_candidates, coalesce(n_accepted, 0) AS n_accepted FROM flags""",
    )
)
def stage_status(spark, sf_dir):
    """MET16, MET7-MET9, POL1, SCR6: gate status in one plan."""
    return gates.stage_status(fixtures.runs(spark, sf_dir), fixtures.prompt_versions(spark), fixtures.judgments(spark, sf_dir), fixtures.iterations(spark, sf_dir))


@query(
    """SELECT r_name AS grp, count(*) AS n, CAST(count(*) FILTER (WHERE toxic = quality) AS DOUBLE) / count(*) AS p FROM labels, (SELECT r_name FROM region WHERE r_regionkey = 0) GROUP BY 1"""
)
def two_raters(spark, sf_dir):
    """MET17's raw agreement of two raters."""
    region = fixtures.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.col("r_name").alias("grp"))
    labels = fixtures.table(spark, sf_dir, "labels").crossJoin(F.broadcast(region))
    return labels.groupBy("grp").agg(F.count("*").alias("n"), (F.count_if(F.col("toxic") == F.col("quality")) / F.count("*")).alias("p"))


def _wilson_sql(z):
    return f"""greatest(0.0::DOUBLE, (p + {z * z} / (2 * n)) / (1 + {z * z} / n) - {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n)) AS low,
  least(1.0::DOUBLE, (p + {z * z} / (2 * n)) / (1 + {z * z} / n) + {z} * sqrt(p * (1 - p) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n)) AS high"""


@query(sql_and("runs", f"acc AS (SELECT model_id, count(*) AS n, avg(CAST(is_correct AS DOUBLE)) AS p FROM runs GROUP BY 1) SELECT model_id, n, p, {_wilson_sql(Z95)} FROM acc"))
def wilson_intervals(spark, sf_dir):
    """MTH2, MET17."""
    acc = fixtures.runs(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("p"))
    low, high = metrics.wilson(F.col("p"), F.col("n"), Z95)
    return acc.withColumn("low", low).withColumn("high", high)


@query(sql_and("runs", f"acc AS (SELECT version, count(*) AS n, avg(CAST(is_correct AS DOUBLE)) AS p FROM runs GROUP BY 1) SELECT version, n, p, {_wilson_sql(Z95_SHORT)} FROM acc"))
def wilson_by_version(spark, sf_dir):
    """MTH2 with the shorter constant."""
    acc = fixtures.runs(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("p"))
    low, high = metrics.wilson(F.col("p"), F.col("n"), Z95_SHORT)
    return acc.withColumn("low", low).withColumn("high", high)


@query(
    sql_and(
        "runs",
        """g AS (SELECT model_id, version, count(*) AS n, count(error) AS n_errors FROM runs GROUP BY 1, 2)
SELECT *, n_errors::DOUBLE / n AS error_rate, CASE WHEN n_errors::DOUBLE / n > 0.3 THEN 'broken' WHEN n_errors::DOUBLE / n > 0.1 THEN 'unstable' ELSE 'reliable' END AS reliability FROM g WHERE n >= 10 AND n_errors::DOUBLE / n > 0.04""",
    )
)
def error_rates(spark, sf_dir):
    """AGG14, AGG18."""
    return summaries.error_rates(fixtures.runs(spark, sf_dir), 10, 0.04)


@query(sql("runs", "SELECT model_id, version, sum(cost_usd) AS cost_usd, sum(co2e_grams) AS co2e_grams, count(*) AS n, sum(cost_usd) / count(*) * 1000 AS cost_per_1k FROM runs GROUP BY ALL ORDER BY cost_usd DESC, model_id, version LIMIT 5"))
def costliest(spark, sf_dir):
    """AGG15, MTH5: a top-k report."""
    return summaries.costliest(fixtures.runs(spark, sf_dir), ["model_id", "version"], 5)


@query(sql("iterations", "SELECT model_id, min(mean_score) AS low, max(mean_score) AS high, count(*) AS n, count(*) FILTER (WHERE accepted) AS n_accepted, CASE WHEN coalesce(min(mean_score), 0) = 0 THEN 0.0 ELSE max(mean_score) - min(mean_score) END AS delta FROM iterations GROUP BY 1"))
def optimizer_improvement(spark, sf_dir):
    """AGG13."""
    return summaries.improvement(fixtures.iterations(spark, sf_dir))


@query(sql("runs", "SELECT record_id, model_id, count(*) AS n FROM runs GROUP BY 1, 2 HAVING count(*) = count(error)"))
def all_failed_pairs(spark, sf_dir):
    """AGG10, SNK21: what a retry takes up."""
    return summaries.all_failed(fixtures.runs(spark, sf_dir), ["record_id", "model_id"])


@query(sql("runs", "SELECT record_id, count(DISTINCT model_id) AS n_fields FROM runs WHERE error IS NULL GROUP BY 1 HAVING count(DISTINCT model_id) = 4"))
def complete_records(spark, sf_dir):
    """AGG11."""
    return summaries.complete_cases(fixtures.runs(spark, sf_dir).where("error IS NULL").withColumn("field_name", F.col("model_id")), 4)


@query(sql_and("runs", "acc AS (SELECT model_id, version, avg(score) AS s FROM runs GROUP BY 1, 2) SELECT version, count(s) AS n, count(*) FILTER (WHERE s >= 0.4) AS n_pass, max(s) AS high, median(s) AS median, quantile_disc(s, 0.5) AS lower_median, min(s) AS low, 100.0::DOUBLE * count(*) FILTER (WHERE s >= 0.4) / count(s) AS pass_pct FROM acc GROUP BY 1"))
def version_summary(spark, sf_dir):
    """AGG17."""
    acc = fixtures.runs(spark, sf_dir).groupBy("model_id", "version").agg(F.avg("score").alias("s"))
    return summaries.field_summary(acc, "version", "s", 0.4)


@query(sql("runs", "SELECT model_id, max(CASE WHEN version = 1 THEN s END) AS v1, max(CASE WHEN version = 2 THEN s END) AS v2, max(CASE WHEN version = 3 THEN s END) AS v3 FROM (SELECT model_id, version, avg(score) AS s FROM runs GROUP BY 1, 2) GROUP BY 1"))
def gate_pivot(spark, sf_dir):
    """AGG19."""
    acc = fixtures.runs(spark, sf_dir).groupBy("model_id", F.concat(F.lit("v"), F.col("version").cast("string")).alias("v")).agg(F.avg("score").alias("s"))
    return acc.groupBy("model_id").pivot("v", ["v1", "v2", "v3"]).agg(F.max("s"))


@query(sql("runs", "SELECT truth, predicted, count(*) AS n FROM runs WHERE predicted <> truth GROUP BY ALL ORDER BY n DESC, truth, predicted LIMIT 10"))
def confused_pairs(spark, sf_dir):
    """AGG22: a top-k report."""
    return summaries.confused_pairs(fixtures.runs(spark, sf_dir))


@query("WITH c AS (SELECT CAST(floor(length(text) / 4) AS BIGINT) AS t FROM conversations), r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM c) SELECT avg(t) AS mean_tokens, min(t) FILTER (WHERE i >= n * 95 // 100) AS p95_tokens, max(t) AS most_tokens FROM r")
def token_estimates(spark, sf_dir):
    """AGG23."""
    return summaries.estimated_tokens(fixtures.table(spark, sf_dir, "conversations"), "text")


@query("""WITH c AS (SELECT 'size' AS label, CASE WHEN p_size < 25 THEN 'small' WHEN p_size < 45 THEN 'large' END AS v FROM part UNION ALL SELECT 'brand', p_brand FROM part), n AS (SELECT label, v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT label, count(*) AS n_labels, first(v ORDER BY n DESC, v) AS commonest, max(n)::DOUBLE / (SELECT count(*) FROM part) AS share, max(n)::DOUBLE / (SELECT count(*) FROM part) > 0.4 AS imbalanced FROM n GROUP BY 1""")
def class_imbalance(spark, sf_dir):
    """AGG23's check: labels of which one stands for too many rows."""
    part = fixtures.table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") < 25, "small").when(F.col("p_size") < 45, "large")).withColumnRenamed("p_brand", "brand")
    found = [summaries.imbalance(part, c).select(F.lit(c).alias("label"), "n_labels", "commonest", "share", "imbalanced") for c in ("size", "brand")]
    return found[0].unionByName(found[1])


@query(sql_and("runs", "s AS (SELECT model_id, version, avg(score) AS score FROM runs GROUP BY 1, 2) SELECT model_id, min_by(score, version) AS first_score, max_by(score, version) AS last_score, count(*) AS n_versions, max_by(score, version) - min_by(score, version) AS delta FROM s GROUP BY 1"))
def version_progression(spark, sf_dir):
    """WIN10, UI5."""
    return versions.progression(fixtures.runs(spark, sf_dir).groupBy("model_id", "version").agg(F.avg("score").alias("score")))


@query(sql_and("runs", "s AS (SELECT model_id, version, avg(score) AS score FROM runs GROUP BY 1, 2) SELECT version, model_id, score FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY score DESC, model_id) AS r FROM s) WHERE r = 1"))
def best_model_per_version(spark, sf_dir):
    """WIN8, WIN9."""
    scores = fixtures.runs(spark, sf_dir).groupBy("version", "model_id").agg(F.avg("score").alias("score"))
    return versions.best_per_group(scores, "version", "score", "model_id")


@query(sql("runs prompt_versions", "SELECT model_id, max(version) + 1 AS next_version FROM runs GROUP BY 1"))
def next_versions(spark, sf_dir):
    """WIN6."""
    return versions.next_version(fixtures.runs(spark, sf_dir), ["model_id"])


@query(sql_and("runs", "s AS (SELECT model_id, avg(score) AS m FROM runs GROUP BY 1) SELECT model_id, m, CASE WHEN m >= 0.42 THEN 'pass' WHEN m >= 0.85 * 0.42 THEN 'near' WHEN m >= 0.70 * 0.42 THEN 'improving' ELSE 'low' END AS band FROM s"))
def status_bands(spark, sf_dir):
    """UI4."""
    s = fixtures.runs(spark, sf_dir).groupBy("model_id").agg(F.avg("score").alias("m"))
    return s.withColumn("band", gates.band(F.col("m") >= 0.42, F.lit(False), F.col("m"), F.lit(0.42)))


@query(f"SELECT {T.gate} AS gate, {T.kappa_gate} AS kappa_gate, {T.recall_floor} AS recall_floor, {T.sensitivity_floor} AS sensitivity_floor, {T.class_support} AS class_support")
def thresholds(spark, sf_dir):
    """SCR7."""
    return spark.range(1).select(*[F.lit(getattr(T, c)).alias(c) for c in ("gate", "kappa_gate", "recall_floor", "sensitivity_floor", "class_support")])
