"""The work queue as streams: claims that no two streams share, and leases that run out by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import T
from ..operators import workflow
from ..operators.tables import durable
from ..sources.snapshots import Snapshots, retried

TASKS = "task_id long, kind string, priority int, status string, worker_id string, request_id long"


def claimed(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """The next pending tasks, one for each request in the order of request_id; a request that has a task gets no second."""
    asking = requests.dropDuplicates(["request_id"]).join(tasks.where("request_id IS NOT NULL").select("request_id"), "request_id", "left_anti")
    asking = durable(asking.select("request_id", F.col("worker_id").alias("_worker")))
    n = asking.count()  # the requests of one micro-batch, which is what the two windows hold
    pending = workflow.next_tasks(tasks, n).withColumn("_at", F.row_number().over(Window.orderBy(F.desc_nulls_last("priority"), "task_id")))
    turns = asking.withColumnRenamed("request_id", "_request").withColumn("_at", F.row_number().over(Window.orderBy("_request")))
    dealt = pending.join(turns, "_at")
    return dealt.select(*[c for c in tasks.columns if c not in ("status", "worker_id", "request_id")], F.lit("running").alias("status"), F.col("_worker").alias("worker_id"), F.col("_request").alias("request_id"))


def claim_batches(queue: Snapshots):
    """For foreachBatch over requests (request_id, worker_id): claims on the newest version of the queue, and again if it moved.

    A batch that is delivered again finds its requests served.
    """

    def claim(batch: DataFrame, _: int) -> None:
        batch = durable(batch.select("request_id", "worker_id"))

        def once(base: int) -> int:
            return queue.upsert(durable(claimed(queue.read(base), batch)), base)

        retried(once, queue)

    return claim


def finish(queue: Snapshots, results: DataFrame) -> int:
    """results (task_id, status: done or failed) of running tasks; others stay as they are."""
    ended = results.select("task_id", F.col("status").alias("_status"))

    def once(base: int) -> int:
        rows = queue.read(base).where("status = 'running'").join(ended, "task_id").withColumn("status", F.col("_status")).drop("_status")
        return queue.upsert(durable(rows), base)

    return retried(once, queue)


class Leases(StatefulProcessor):
    """Per task when its lease ends: claims and beats in time renew it, a finish ends it, and its timer tells that it ran out."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "ends_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(at), str(kind)) for part in rows for at, kind in zip(part["at_ms"], part["kind"], strict=True))
        before = ends = self.ends.get()[0] if self.ends.exists() else None
        over = []
        for at, kind in events:
            if ends is not None and at > ends:
                over.append(ends)
                ends = None
            if kind == "claim" or ends is not None:
                ends = None if kind == "finish" else at + self.lease_ms
        if before is not None and before != ends:
            self.handle.deleteTimer(before)
        if ends is None:
            self.ends.clear()
        else:
            self.ends.update((ends,))
            if before != ends:
                self.handle.registerTimer(ends)
        yield pd.DataFrame({"task_id": [key[0]] * len(over), "requeued_ms": over})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()[0] if self.ends.exists() else None
        if ends is not None and ends <= expiredTimerInfo.getExpiryTimeInMs():
            self.ends.clear()
            yield pd.DataFrame({"task_id": [key[0]], "requeued_ms": [ends]})

    def close(self) -> None:
        pass


def expired_leases(events: DataFrame, lease_s: int = T.stale_job_s, late: str = "10 minutes") -> DataFrame:
    """events (task_id, at, kind: claim, beat or finish) as a stream: (task_id, requeued_ms) when a lease ran out.

    A lease runs out once the watermark has passed its end, without any event of its task. Events of one task in a
    micro-batch are taken in the order of their times.
    """
    ready = events.withWatermark("at", late).select("task_id", "at", F.unix_millis("at").alias("at_ms"), "kind")
    found = ready.groupBy("task_id").transformWithStateInPandas(Leases(lease_s * 1000), "task_id long, requeued_ms long", "Append", "EventTime")
    return found


def with_rocksdb(spark: SparkSession):
    """The state store that timers need, for streams that start within this context."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key, None)
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            yield
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)

    return held()
