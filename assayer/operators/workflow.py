"""Work queue, jobs and liveness as queries over event logs; times are compared with a given `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import T


def micros(at: Column) -> Column:
    """Microseconds since the epoch; a time without zone is one of the session's zone."""
    return F.unix_micros(at.cast("timestamp"))


def queue_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("kind").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done")])


def next_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The tasks to be claimed next: highest priority, then lowest id."""
    return tasks.where("status = 'pending'").orderBy(F.desc_nulls_last("priority"), "task_id").limit(n)


def assign(tasks: DataFrame, workers: list[str]) -> DataFrame:
    """Deals the next tasks to workers, one each, in one batch: no two workers get the same task."""
    order = Window.orderBy(F.desc_nulls_last("priority"), "task_id")
    ranked = next_tasks(tasks, len(workers)).withColumn("rank", F.row_number().over(order))
    names = F.array(*[F.lit(w) for w in workers])
    return ranked.withColumn("worker_id", F.element_at(names, F.col("rank"))).drop("rank")


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks that no active one equals, each once."""
    active = tasks.where("status IN ('pending', 'running')").select("kind", "args")
    return new.dropDuplicates(["kind", "args"]).join(active, ["kind", "args"], "left_anti")


def expired(tasks: DataFrame, as_of: Column, seconds: int = T.stale_job_s) -> DataFrame:
    """Running tasks whose lease is over and that go back to pending."""
    late = micros(F.col("claimed_at")) < micros(as_of) - seconds * 1_000_000
    return tasks.where((F.col("status") == "running") & late)


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    values = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("s")).select(key, "s.*")


def liveness(beats: DataFrame, as_of: Column) -> DataFrame:
    """Agents with the age of their last beat and if they are stale: silent for three intervals, 15 minutes at least."""
    age = (micros(as_of) - micros(F.col("updated_at"))) / 1e6
    limit = F.greatest(3 * F.col("interval_s"), F.lit(T.least_heartbeat_s))
    return beats.withColumn("age_s", age).withColumn("is_stale", (age > limit) & (F.col("status") != "stopped"))


def recent_health(tasks: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Finished tasks of the last hours by kind."""
    recent = tasks.where((F.col("claimed_at") > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("claimed_at") <= as_of))
    return recent.groupBy("kind").agg(F.count("*").alias("n"), (F.count_if(F.col("status") == "done") / F.count("*")).alias("done_rate"))


def unjudged(runs: DataFrame, judgments: DataFrame, judge: str) -> DataFrame:
    """The runs that this judge hasn't judged."""
    return runs.join(judgments.where(F.col("judge_model") == judge).select("run_id"), "run_id", "left_anti")


def optimizer_health(tasks: DataFrame, iterations: DataFrame, as_of: Column, hours: int = 24, kind: str = "optimization") -> DataFrame:
    """One row: finished optimizer tasks of the last hours and the share that failed, candidates and the share that was accepted."""
    since = lambda c: (F.col(c) > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(c) <= as_of)
    ended = tasks.where((F.col("kind") == kind) & F.col("status").isin("done", "failed") & since("finished_at")).agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    tried = iterations.where(since("created_at")).agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return ended.join(F.broadcast(tried)).withColumns({"failure_rate": rate("n_failed", "n_runs"), "accept_rate": rate("n_accepted", "n_candidates")})
