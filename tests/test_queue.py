"""Tables of snapshots, claims from several streams, leases with timers."""

import datetime
import threading

import pytest

from assayer.sources import snapshots
from assayer.sources.snapshots import Conflict, Snapshots
from assayer.streaming import queue, run_log

SCHEMA = "id long, v string"


def table(spark, tmp_path, **more):
    return Snapshots(spark, f"file://{tmp_path}/primary", SCHEMA, ["id"], **more)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_updates_replace_the_files_of_their_buckets(spark, tmp_path):
    held = table(spark, tmp_path)
    assert held.version() == 0 and told(held.read()) == []
    assert held.upsert(rows(spark, *[(k, "a") for k in range(40)])) == 1
    before = held.manifest(1)
    assert held.upsert(rows(spark, (3, "b"), (100, "c"))) == 2
    after = held.manifest(2)
    changed = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(changed) <= 2 < len(after)
    assert told(held.read()) == sorted([(k, "b" if k == 3 else "a") for k in range(40)] + [(100, "c")])
    assert told(held.read(1)) == [(k, "a") for k in range(40)]
    assert held.delete(rows(spark, *[(k, "") for k in range(40)])) == 3
    assert told(held.read()) == [(100, "c")]
    assert held.delete(rows(spark, (100, ""))) == 4 and told(held.read()) == []
    assert held.upsert(rows(spark)) == 4  # nothing to do is no version


def test_a_version_is_made_once(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.upsert(rows(spark, (1, "a")))
    base = one.version()
    one.upsert(rows(spark, (1, "b")), base)
    with pytest.raises(Conflict):
        two.upsert(rows(spark, (1, "c")), base)
    assert told(two.read()) == [(1, "b")]
    assert snapshots.retried(lambda at: two.upsert(rows(spark, (1, "c")), at), two) == 3 and told(one.read()) == [(1, "c")]


@pytest.mark.parametrize("step", ["mirror_files", "manifest", "mirror_manifest"])
def test_a_failure_between_the_writes_leaves_one_version(spark, tmp_path, monkeypatch, step):
    more = {"mirror": f"file://{tmp_path}/mirror"}
    held = table(spark, tmp_path, **more)
    held.upsert(rows(spark, (1, "a"), (2, "a")))

    publish, filled = Snapshots._publish, Snapshots._filled

    def fails(self, place, version, text):
        if place.endswith("mirror" if step == "mirror_manifest" else "primary"):
            raise OSError("the place is gone")
        return publish(self, place, version, text)

    def unreadable(self, name):
        raise OSError("the place is gone")

    monkeypatch.setattr(Snapshots, "_filled" if step == "mirror_files" else "_publish", unreadable if step == "mirror_files" else fails)
    with pytest.raises(OSError):
        held.upsert(rows(spark, (2, "b"), (3, "b")))
    monkeypatch.setattr(Snapshots, "_publish", publish)
    monkeypatch.setattr(Snapshots, "_filled", filled)
    again = table(spark, tmp_path, **more)
    wanted = [(1, "a"), (2, "b"), (3, "b")] if step == "mirror_manifest" else [(1, "a"), (2, "a")]
    assert told(again.read()) == told(again.read(from_mirror=True)) == wanted
    again.upsert(rows(spark, (4, "d")))
    assert told(again.read()) == told(again.read(from_mirror=True)) == [*wanted, (4, "d")]


def tasks(spark, n):
    return spark.createDataFrame([(k, "judge", k % 5 if k % 7 else None, "pending" if k % 4 else "done", None, None) for k in range(n)], queue.TASKS)


def test_two_streams_never_claim_a_task_twice(spark, tmp_path):
    held = Snapshots(spark, f"file://{tmp_path}/queue", queue.TASKS, ["task_id"], buckets=4)
    held.upsert(tasks(spark, 60))
    for name, start in (("a", 0), ("b", 1000)):
        for part in range(3):
            asking = [(start + 10 * part + k, f"{name}{k}") for k in range(6)]
            spark.createDataFrame(asking, "request_id long, worker_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    streams, errors = [], []

    def run(name):
        try:
            asking = spark.readStream.schema("request_id long, worker_id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
            mine = Snapshots(spark, f"file://{tmp_path}/queue", queue.TASKS, ["task_id"], buckets=4)
            stream = asking.writeStream.foreachBatch(queue.claim_batches(mine)).option("checkpointLocation", f"{tmp_path}/at-{name}").trigger(availableNow=True).start()
            streams.append(stream)
            stream.awaitTermination()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(x,)) for x in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    running = held.read().where("status = 'running'").collect()
    assert len(running) == 36 == len({r.task_id for r in running}) == len({r.request_id for r in running})
    first = {r.task_id for r in held.read(1).where("status = 'pending'").orderBy("priority", ascending=False).collect() if r.priority == 4}
    assert first <= {r.task_id for r in running}
    again = spark.createDataFrame([(0, "a0"), (2000, "late")], "request_id long, worker_id string")
    queue.claim_batches(held)(again, 7)  # a batch that is delivered again: one request is served already
    assert held.read().where("status = 'running'").count() == 37
    queue.finish(held, spark.createDataFrame([(running[0].task_id, "done"), (0, "failed")], "task_id long, status string"))
    ended = {r.task_id: r.status for r in held.read().where(f"task_id IN (0, {running[0].task_id})").collect()}
    assert ended == {running[0].task_id: "done", 0: "done"}  # task 0 wasn't running


def test_leases_run_out_without_an_event(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [
        [(1, 0, "claim"), (2, 0, "claim"), (3, 0, "beat"), (4, 0, "claim")],
        [(1, 200, "beat"), (2, 100, "finish"), (4, 290, "beat"), (4, 550, "beat")],
        [(5, 1000, "claim"), (1, 450, "beat")],  # 1 is renewed in time, 4's lease ends at 850
        [(6, 3000, "beat"), (5, 1299, "beat"), (5, 1500, "claim")],
        [(6, 9000, "beat")],
    ]
    for batch in batches:
        frame = spark.createDataFrame([(k, at(s), kind) for k, s, kind in batch], "task_id long, at timestamp, kind string")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    events = spark.readStream.schema("task_id long, at timestamp, kind string").parquet(f"{tmp_path}/log")
    with queue.with_rocksdb(spark):
        found = run_log.run_once(queue.expired_leases(events, 300, "1000 seconds"), "append", f"file://{tmp_path}/out").collect()
    ends = {(r.task_id, round(r.requeued_ms / 1000 - at(0).replace(tzinfo=datetime.UTC).timestamp())) for r in found}
    assert ends == {(1, 750), (4, 850), (5, 1800)} and len(found) == 3
