"""Sampling, sets, queue, jobs, streams and mutations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import gates, listings, sampling, scoring, summaries, tables, versions, workflow
from ..sources import fixtures, sinks, snapshots
from ..sources.fixtures import sql, sql_and
from ..streaming import queue, run_log
from .registry import query


@query(sql("tasks", "SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done FROM tasks GROUP BY 1"))
def queue_counts(spark, sf_dir):
    """AGG9, STM5."""
    return workflow.queue_counts(fixtures.tasks(spark, sf_dir))


@query(sql("tasks", "SELECT task_id, kind, priority FROM tasks WHERE status = 'pending' ORDER BY priority DESC NULLS LAST, task_id LIMIT 50"))
def next_tasks(spark, sf_dir):
    """SRT3: a top-k report."""
    return workflow.next_tasks(fixtures.tasks(spark, sf_dir), 50).select("task_id", "kind", "priority")


@query(sql("tasks", "SELECT task_id, 'w' || CAST(row_number() OVER (ORDER BY priority DESC NULLS LAST, task_id) AS VARCHAR) AS worker_id FROM tasks WHERE status = 'pending' ORDER BY priority DESC NULLS LAST, task_id LIMIT 4"))
def task_assignment(spark, sf_dir):
    """STM2, STM9: one task for each worker."""
    return workflow.assign(fixtures.tasks(spark, sf_dir), ["w1", "w2", "w3", "w4"]).select("task_id", "worker_id")


@query(sql("tasks", "SELECT DISTINCT 'kind' || CAST(c_custkey % 4 AS VARCHAR) AS kind, c_custkey % 60 AS args FROM customer EXCEPT SELECT kind, args FROM tasks WHERE status IN ('pending', 'running')"))
def enqueue_new(spark, sf_dir):
    """STM3."""
    new = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("kind"), (F.col("c_custkey") % 4).cast("string")).alias("kind"), (F.col("c_custkey") % 60).alias("args"))
    return workflow.enqueue(fixtures.tasks(spark, sf_dir), new).select("kind", "args")


@query(sql("tasks", "SELECT task_id, kind FROM tasks WHERE status = 'running' AND claimed_at < (SELECT max(claimed_at) FROM tasks) - INTERVAL 300 SECONDS"))
def expired_leases(spark, sf_dir):
    """STM4, DAT2."""
    tasks = fixtures.tasks(spark, sf_dir)
    last = tasks.agg(F.max("claimed_at").alias("as_of"))
    return workflow.expired(tasks.crossJoin(F.broadcast(last)), F.col("as_of")).select("task_id", "kind")


@query(sql("tasks", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE status = 'done')::DOUBLE / count(*) AS done_rate FROM tasks, (SELECT max(claimed_at) AS m FROM tasks) WHERE claimed_at > m - INTERVAL 2400 HOURS AND claimed_at <= m GROUP BY 1"))
def recent_health(spark, sf_dir):
    """FLT6, AGG9: the window is a parameter."""
    tasks = fixtures.tasks(spark, sf_dir)
    last = tasks.agg(F.max("claimed_at").alias("as_of"))
    return workflow.recent_health(tasks.crossJoin(F.broadcast(last)), F.col("as_of"), 2400)


@query("SELECT user_id, event_type AS status, ts AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_states(spark, sf_dir):
    """STM6, STM7, SNK5: the last event of each key."""
    events = fixtures.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), "event_id")
    return workflow.latest_state(events, "user_id", ["updated_at", "event_id"]).drop("event_id")


@query("""WITH b AS (SELECT user_id, event_type AS status, ts AS updated_at, CAST(user_id % 900 AS INTEGER) AS interval_s FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT max(ts) AS as_of FROM events) SELECT user_id, (epoch_us(as_of) - epoch_us(updated_at)) / 1e6::DOUBLE AS age_s, (epoch_us(as_of) - epoch_us(updated_at)) / 1e6::DOUBLE > greatest(3 * interval_s, 900) AND status <> 'click' AS is_stale FROM b, m""")
def agent_liveness(spark, sf_dir):
    """DAT1, DAT2, STM6: a click stands for stopped."""
    events = fixtures.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "stopped").otherwise(F.col("event_type"))
    beats = workflow.latest_state(events.select("user_id", status.alias("status"), F.col("ts").alias("updated_at"), "event_id", (F.col("user_id") % 900).cast("int").alias("interval_s")), "user_id", ["updated_at", "event_id"])
    last = events.agg(F.max("ts").alias("as_of"))
    return workflow.liveness(beats.crossJoin(F.broadcast(last)), F.col("as_of")).select("user_id", "age_s", "is_stale")


@query(sql("runs", "SELECT run_id, model_id, created_at FROM runs WHERE model_id = 'm1' ORDER BY created_at DESC, run_id DESC LIMIT 2000"))
def newest_runs(spark, sf_dir):
    """SRT1, SRT2, SRC1, FLT1: the limit is the feature; one that is asked for is held in 1 to 2000."""
    return listings.newest(fixtures.runs(spark, sf_dir).where("model_id = 'm1'").select("run_id", "model_id", "created_at"), ["created_at", "run_id"], 99_999)


@query("SELECT p_partkey FROM part ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    """SMP1, SMP6: sampling is the feature."""
    return sampling.sample(fixtures.table(spark, sf_dir, "part"), "p_partkey", 100, 42).select("p_partkey")


@query("SELECT i AS iteration, p_partkey FROM (SELECT CAST(i AS INTEGER) AS i, p_partkey, row_number() OVER (PARTITION BY i ORDER BY md5('9:' || i || ':' || p_partkey), p_partkey) AS n FROM part, range(5) t(i)) WHERE n <= 8")
def minibatches(spark, sf_dir):
    """SMP5: eight rows for each iteration, drawn anew; sampling is the feature."""
    return sampling.minibatches(fixtures.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 9, 5)


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS i, count(*) OVER () AS n FROM part),
c AS (SELECT *, least(400, n // 3) AS h FROM r) SELECT p_partkey, CASE WHEN i <= h THEN 'holdout' WHEN i <= h + least(300, greatest(1, (n - h) // 2)) THEN 'val' ELSE 'train' END AS part FROM c""")
def splits(spark, sf_dir):
    """SMP2."""
    return sampling.split(fixtures.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7, 400, 300)


@query("""SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('3:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS t FROM part) ORDER BY t, p_brand LIMIT 60""")
def stratified_sample(spark, sf_dir):
    """SMP7, WIN14: sampling is the feature."""
    return sampling.round_robin(fixtures.table(spark, sf_dir, "part"), "p_brand", "p_partkey", 60, 3).select("p_partkey", "p_brand")


@query(sql("runs", "SELECT DISTINCT record_id, model_id FROM runs EXCEPT SELECT record_id, model_id FROM runs WHERE error IS NULL"))
def pending_pairs(spark, sf_dir):
    """SET3, STM8."""
    runs = fixtures.runs(spark, sf_dir)
    return sampling.pending(runs.select("record_id", "model_id").distinct(), runs.where("error IS NULL"), ["record_id", "model_id"])


@query(sql_and("runs judgments", "j AS (SELECT run_id FROM judgments) SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM j)"))
def unjudged_runs(spark, sf_dir):
    """JON7, JON8."""
    return fixtures.runs(spark, sf_dir).select("run_id").join(fixtures.judgments(spark, sf_dir), "run_id", "left_anti")


@query(sql_and("runs judgments", "j AS (SELECT run_id, 'judge-' || CAST(run_id % 2 AS VARCHAR) AS judge_model FROM judgments) SELECT r.run_id FROM runs r LEFT JOIN j ON j.run_id = r.run_id AND j.judge_model = 'judge-1' WHERE j.run_id IS NULL AND r.predicted IS NOT NULL"))
def unjudged_by_judge(spark, sf_dir):
    """JON6: answers that one judge hasn't judged, whoever else has."""
    said = fixtures.judgments(spark, sf_dir).withColumn("judge_model", F.concat(F.lit("judge-"), (F.col("run_id") % 2).cast("string")))
    return workflow.unjudged(fixtures.runs(spark, sf_dir).where("predicted IS NOT NULL").select("run_id"), said, "judge-1")


@query(sql_and("runs", """f AS (SELECT record_id, model_id, min(truth) AS truth FROM runs GROUP BY 1, 2 HAVING count(*) = count(error)),
r AS (SELECT *, CASE record_id % 4 WHEN 0 THEN truth WHEN 1 THEN 'zz' END AS predicted FROM f)
SELECT record_id, model_id, predicted, CASE WHEN record_id % 4 = 2 THEN 'no JSON object in the reply' END AS error, CASE WHEN record_id % 4 = 2 THEN NULL WHEN predicted IS NULL THEN 'abstain_miss' WHEN predicted = truth THEN 'hit' ELSE 'wrong' END AS outcome FROM r"""))
def retried_runs(spark, sf_dir):
    """SNK21, AGG10: replies for the pairs that only failed, parsed and scored as runs to be appended; some can't be read again."""
    runs = fixtures.runs(spark, sf_dir)
    k = F.col("record_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('Sure: {"value": "'), F.min("truth"), F.lit('"}'))).when(k == 1, '{"value": "zz"}').when(k == 2, "sorry").otherwise('{"value": null}')
    replies = runs.groupBy("record_id", "model_id").agg(raw.alias("raw"), F.min("truth").alias("truth"))
    return scoring.retried(runs, replies, ["record_id", "model_id"]).select("record_id", "model_id", "predicted", "error", "result.outcome")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy_parents(spark, sf_dir):
    """JON15: sub-sector to sector."""
    region = fixtures.table(spark, sf_dir, "region")
    return fixtures.table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query(sql_and("list_pairs", "x AS (SELECT record_id, truth, predicted, list_transform(truth, lambda v: lower(v)) AS t, list_transform(predicted, lambda v: lower(v)) AS p FROM list_pairs) SELECT record_id, array_to_string(list_filter(truth, lambda v, i: NOT list_contains(p, lower(v)) AND list_position(t, lower(v)) = i), ';') AS missing, array_to_string(list_filter(predicted, lambda v, i: NOT list_contains(t, lower(v)) AND list_position(p, lower(v)) = i), ';') AS extra FROM x"))
def misses_and_extras(spark, sf_dir):
    """SET2, SET4, ARR2: by folded value, each once, in their order and letters."""
    pairs = fixtures.list_pairs(spark, sf_dir)
    upper = pairs.withColumn("folded", F.transform("predicted", lambda x: F.upper(x)))
    return upper.select("record_id", F.array_join(listings.not_in("truth", "folded"), ";").alias("missing"), F.array_join(listings.not_in("predicted", "truth"), ";").alias("extra"))


@query("""WITH v AS (SELECT p_partkey // 4 AS record_id, p_partkey AS o, p_brand AS v FROM part WHERE p_partkey % 5 <> 0) SELECT record_id, string_agg(v, ';' ORDER BY o) AS listed, first(v ORDER BY o) AS first_value, count(DISTINCT v) AS n_distinct FROM v GROUP BY 1""")
def truth_build(spark, sf_dir):
    """AGG12, ARR3: blanks dropped, order kept."""
    part = fixtures.table(spark, sf_dir, "part").select(F.expr("p_partkey div 4").alias("record_id"), F.col("p_partkey").alias("o"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise(" ").alias("v"))
    found = summaries.first_values(part, "record_id", "o", "v")
    return found.select("record_id", F.array_join("listed", ";").alias("listed"), "first_value", F.size("distinct_values").cast("long").alias("n_distinct"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 3 = 0""")
def upsert(spark, sf_dir):
    """SNK3, SNK4, GTQ6: changed and added rows."""
    old = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = old.where("id % 3 = 0").withColumn("v", F.lit("new"))
    return sinks.upsert(old, new.unionByName(new.withColumn("id", F.col("id") + 1_000_000)), ["id"])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_matching(spark, sf_dir):
    """SNK8."""
    gone = fixtures.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return sinks.delete_matching(fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), gone, ["id"])


@query(sql("runs", "SELECT run_id, score, is_correct, confidence AS new_score, confidence >= 0.9 AS new_is_correct FROM runs WHERE abs(score - confidence) > 1e-9 OR is_correct <> (confidence >= 0.9)"))
def rescored_runs(spark, sf_dir):
    """SNK6: what a rescoring would change."""
    runs = fixtures.runs(spark, sf_dir)
    new = runs.select("run_id", F.col("confidence").alias("score"), (F.col("confidence") >= 0.9).alias("is_correct"))
    return scoring.rescored(runs.select("run_id", "score", "is_correct"), new, "run_id")


@query(sql_and("runs", "c AS (SELECT record_id, truth, count(*) AS n, min(run_id) AS f FROM runs GROUP BY 1, 2) SELECT record_id, CAST(sum(n) AS BIGINT) AS n_samples, first(truth ORDER BY n DESC, f) AS modal_value, first(n ORDER BY n DESC, f)::DOUBLE / sum(n) AS agreement FROM c GROUP BY 1"))
def self_consistency(spark, sf_dir):
    """MET12: here no two different answers are alike, so clusters are equal answers; tests cover the others."""
    return scoring.consensus(fixtures.runs(spark, sf_dir), ["record_id"], "run_id", "truth")


@query(sql_and("runs", """c AS (SELECT model_id, record_id // 10 AS g, truth, count(*) AS n, min(run_id) AS f FROM runs GROUP BY ALL), k AS (SELECT model_id, g, first(n ORDER BY n DESC, f)::DOUBLE / sum(n) AS agreement FROM c GROUP BY 1, 2)
SELECT model_id, count(*) AS n, avg(agreement) AS mean_agreement, count(*) FILTER (WHERE agreement = 1) AS n_unanimous FROM k GROUP BY 1"""))
def consistency_by_model(spark, sf_dir):
    """AGG5: ten runs of a model are taken as samples of one record."""
    samples = fixtures.runs(spark, sf_dir).withColumn("record_id", F.expr("record_id div 10"))
    return scoring.consistency_summary(scoring.consensus(samples, ["model_id", "record_id"], "run_id", "truth"), ["model_id"])


@query("""SELECT n, since, CASE WHEN n >= 25 THEN 'budget' WHEN n >= 5 AND since >= 3 THEN CASE WHEN 0.9 - best > 0.05 THEN 'task_limited' ELSE 'plateaued' END ELSE 'optimize' END AS status
FROM (SELECT p_partkey, p_size AS n, CAST(p_partkey % 6 AS INTEGER) AS since, (p_partkey % 100) / 100.0::DOUBLE AS best FROM part)""")
def stop_rule(spark, sf_dir):
    """POL1."""
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_size").alias("n"), (F.col("p_partkey") % 6).cast("int").alias("since"), (F.col("p_partkey") % 100 / 100).alias("best"))
    return part.select("n", "since", gates.stop_status(F.col("n"), F.col("since"), F.col("best"), F.lit(0.9)).alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'extract' WHEN p_size % 7 = 1 THEN 'judge' WHEN p_size % 4 = 0 THEN 'judge' WHEN p_size % 3 = 1 THEN 'optimize'
  WHEN p_size % 2 = 0 AND p_size < 20 THEN 'extract' WHEN p_size % 2 = 0 THEN 'done' WHEN p_size % 3 = 2 THEN 'review' ELSE 'stuck' END AS action FROM part""")
def next_actions(spark, sf_dir):
    """POL3 over made-up states, so that every action is reached; field_actions derives the states."""
    s = F.col("p_size")
    state = fixtures.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(s % 5 == 0, 0).otherwise(s * 5).alias("refs"), F.when(s % 7 == 1, 1).otherwise(0).alias("unjudged"), (s % 4).alias("n_evaluated"),
        F.when(s % 3 == 1, 1).otherwise(0).alias("n_optimizable"), F.when(s % 3 == 2, 1).otherwise(0).alias("n_flagged"), (s % 2 == 0).alias("best_passes"),
    )
    return gates.next_action(state).select("p_partkey", "action")


@query("""SELECT p_partkey, (p_partkey % 97) / 97.0::DOUBLE > (p_partkey % 89) / 89.0::DOUBLE + e AND p_size % 2 = 0 AND (p_partkey % 83) / 83.0::DOUBLE >= (p_partkey % 79) / 79.0::DOUBLE - e AS accepted FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 0.03::DOUBLE WHEN 1 THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END AS e FROM part)""")
def acceptance(spark, sf_dir):
    """POL4: better on validation by the field's epsilon, above the floor, and no worse on held-out rows."""
    at = lambda n: F.col("p_partkey") % n / n
    rows = fixtures.table(spark, sf_dir, "part").select("p_partkey", at(97).alias("val_score"), at(89).alias("best_score"), at(83).alias("holdout_score"), at(79).alias("holdout_best"), (F.col("p_size") % 2 == 0).alias("floor_ok"))
    field = F.element_at(F.array(*[F.lit(f) for f in ("authors", "author_affiliation", "sector_name", "sub_sector")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return gates.accepts(rows, gates.epsilon(field)).select("p_partkey", "accepted")


@query(sql_and("runs", "own AS (SELECT model_id, max(version) AS version FROM runs WHERE model_id IN ('m0', 'm2') GROUP BY 1), m AS (SELECT DISTINCT model_id FROM runs) SELECT m.model_id, coalesce(version, 1) AS version, version IS NULL AS is_shared FROM m LEFT JOIN own USING (model_id)"))
def prompt_fallback(spark, sf_dir):
    """WIN3, JON4."""
    runs = fixtures.runs(spark, sf_dir)
    own = runs.where("model_id IN ('m0', 'm2')").groupBy("model_id").agg(F.max("version").alias("version"))
    shared = spark.range(1).select(F.lit(1).alias("version"))
    return versions.with_fallback(runs.select("model_id").distinct(), own, shared)


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    """The table's one file, or its folder, as a stream."""
    return spark.readStream.schema(run_log.EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _queue(spark, sf_dir) -> snapshots.Snapshots:
    """The tasks as a table that changes."""
    held = snapshots.Snapshots(spark, _folder(spark, "queue"), queue.TASKS, ["task_id"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("worker_id", "string"), ("request_id", "long"))]
    held.upsert(fixtures.tasks(spark, sf_dir).select("task_id", "kind", "priority", "status", *none))
    return held


@query(sql_and("tasks", """p AS (SELECT task_id, row_number() OVER (ORDER BY priority DESC NULLS LAST, task_id) AS nth FROM tasks WHERE status = 'pending'),
r AS (SELECT s_suppkey AS request_id, s_name AS worker_id, row_number() OVER (ORDER BY s_suppkey) AS nth FROM supplier)
SELECT task_id, worker_id, request_id, CASE WHEN request_id % 3 = 0 THEN 'done' ELSE 'running' END AS status FROM p JOIN r USING (nth)"""))
def claimed_tasks(spark, sf_dir):
    """STM2, STM9: requests for tasks as a stream, claims on a versioned queue, and some of them finished."""
    held = _queue(spark, sf_dir)
    requests = spark.readStream.schema("s_suppkey long, s_name string").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/supplier.parquet*")
    requests = requests.select(F.col("s_suppkey").alias("request_id"), F.col("s_name").alias("worker_id"))
    claims = requests.writeStream.foreachBatch(queue.claim_batches(held)).option("checkpointLocation", _folder(spark, "claims")).trigger(availableNow=True).start()
    claims.awaitTermination()
    mine = held.read().where("request_id IS NOT NULL AND status = 'running'")
    queue.finish(held, mine.where("request_id % 3 = 0").select("task_id", F.lit("done").alias("status")))
    return held.read().where("request_id IS NOT NULL").select("task_id", "worker_id", "request_id", "status")


@query("""WITH e AS (SELECT user_id AS task_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'claim' ELSE 'beat' END AS kind, event_id FROM events),
s AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 21600000 AND lag(kind) OVER w <> 'finish' THEN 0 ELSE 1 END AS begins FROM e WINDOW w AS (PARTITION BY task_id ORDER BY ms, kind)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY task_id ORDER BY ms, kind ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT task_id, max(ms) + 21600000 AS requeued_ms FROM g GROUP BY task_id, island HAVING bool_or(kind = 'claim') AND max_by(kind, ms) <> 'finish' AND max(ms) + 21600000 <= (SELECT max(ms) - 600000 FROM e)""")
def requeued_leases(spark, sf_dir):
    """STM4: leases of six hours over the event log as a stream; beats renew them, timers tell that they ran out."""
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "signup", "claim").otherwise("beat")
    events = _stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("ts").alias("at"), kind.alias("kind"))
    with queue.with_rocksdb(spark):
        return run_log.run_once(queue.expired_leases(events, 6 * 3600), "append", _folder(spark, "leases"))


@query(sql_and("runs", """s AS (SELECT run_id, CASE WHEN abs(score - confidence) > 1e-9 OR is_correct <> (confidence >= 0.9) THEN confidence ELSE score END AS score,
  CASE WHEN abs(score - confidence) > 1e-9 OR is_correct <> (confidence >= 0.9) THEN confidence >= 0.9 ELSE is_correct END AS is_correct FROM runs WHERE run_id % 2 = 0 UNION ALL SELECT run_id, score, is_correct FROM runs WHERE run_id % 2 = 1)
SELECT run_id, score, is_correct FROM s WHERE run_id % 10 <> 7"""))
def mirrored_scores(spark, sf_dir):
    """SNK5, SNK6, SNK8, SNK16: scores in a table of snapshots and its mirror; changed rows are replaced, others deleted, and the mirror is read."""
    folder = _folder(spark, "scores")
    held = snapshots.Snapshots(spark, f"{folder}/primary", "run_id long, score double, is_correct boolean", ["run_id"], mirror=f"{folder}/mirror")
    runs = fixtures.runs(spark, sf_dir)
    held.upsert(runs.select("run_id", "score", "is_correct"))
    new = runs.where("run_id % 2 = 0").select("run_id", F.col("confidence").alias("score"), (F.col("confidence") >= 0.9).alias("is_correct"))
    changed = scoring.rescored(held.read(), new, "run_id").select("run_id", F.col("new_score").alias("score"), F.col("new_is_correct").alias("is_correct"))
    held.upsert(tables.durable(changed))
    held.delete(runs.where("run_id % 10 = 7").select("run_id"))
    return held.read(from_mirror=True)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def streamed_rates(spark, sf_dir):
    """STM1: windows over the run log as a stream, the same rows as in batch."""
    return run_log.run_once(run_log.windowed_rates(_stream(spark, sf_dir)), "complete", _folder(spark, "rates"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def batch_rates(spark, sf_dir):
    """STM1's batch form."""
    return run_log.windowed_rates(fixtures.table(spark, sf_dir, "events"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def activity_sessions(spark, sf_dir):
    """An extension of STM1: sessions of a user."""
    return run_log.sessions(fixtures.table(spark, sf_dir, "events"))
