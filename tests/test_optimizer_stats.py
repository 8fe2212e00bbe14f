"""Optimizer statistics without a window that holds a model's iterations in one task."""

from assayer.operators import summaries


def test_optimizer_stats(spark):
    data = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("b", 1, False), ("b", 2, None), (None, 1, True), (None, 5, False)]
    found = summaries.optimizer_stats(spark.createDataFrame(data, "model_id string, created_at int, accepted boolean"))
    assert {tuple(r) for r in found.collect()} == {("a", 4, 2, 1), ("b", 2, 0, 2), (None, 2, 1, 1)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
