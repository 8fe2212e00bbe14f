"""Gates by kind of field, ranks and prefix sums, against plain versions."""

import random
from collections import defaultdict

import pytest

from assayer.operators import gating, ranks

KINDS = {"sector_name": "single_categorical", "region": "single_categorical", "authors": "list_text"}
SCHEMA = "run_id long, record_id long, field_name string, model_id string, version int, truth array<string>, predicted array<string>, error string, cost_usd double, co2e_grams double"


def answer(n, field, truth, predicted, model="m", version=1, error=None):
    return (n, n, field, model, version, truth, predicted, error, 1.0, 2.0)


def test_gates_by_kind(spark):
    rows = [answer(k, "sector_name", [x], [y]) for k, (x, y) in enumerate([("a", "a")] * 8 + [("b", "b")] * 7 + [("b", "a")])]
    rows += [answer(100 + k, "region", [x], y) for k, (x, y) in enumerate([("a", ["a"])] * 19 + [("b", [None])])]
    rows += [answer(200 + k, "authors", ["Okoro, Ada", "Lee, Kim"], ["Ada Okoro", "Lee, K. and others"]) for k in range(3)] + [answer(300, "authors", ["Diaz, Eva"], None), answer(301, "authors", [], [])]
    found = {r.field_name: r for r in gating.gate_metrics(spark.createDataFrame(rows, SCHEMA), KINDS, ["model_id"]).collect()}
    sector, region, authors = (found[x] for x in ("sector_name", "region", "authors"))
    po, pe = 15 / 16, (9 / 16) * (8 / 16) + (7 / 16) * (8 / 16)
    assert sector.metric_name == "kappa" and sector.metric == pytest.approx((po - pe) / (1 - pe)) and sector.passes and sector.floor_ok
    assert region.metric_name == "accuracy" and region.metric == pytest.approx(0.95) and region.passes and not region.sensitivity_gateable
    assert authors.metric_name == "f1" and authors.recall == pytest.approx(3 / 7) and authors.precision == pytest.approx(3 / 6)
    assert authors.metric == pytest.approx(2 * 3 / 13) and not authors.floor_ok and not authors.passes
    with pytest.raises(ValueError):
        gating.gate_metrics(spark.createDataFrame(rows, SCHEMA), {"x": "number"}, [])


def test_versions_in_force(spark):
    prompts = spark.createDataFrame(
        [("f", "m1", 1, True), ("f", "m1", 2, True), ("f", "m1", 3, False), ("f", None, 1, True), ("f", None, 4, True), ("f", "m2", 5, False), ("g", "m1", 1, False)],
        "field_name string, model_id string, version int, accepted boolean",
    )
    models = spark.createDataFrame([("f", "m1"), ("f", "m2"), ("f", "m3"), ("g", "m1")], "field_name string, model_id string")
    assert {tuple(r) for r in gating.current_versions(prompts, models).collect()} == {("f", "m1", 2), ("f", "m2", 4), ("f", "m3", 4)}


def test_field_states(spark):
    models = [
        # field, refs, unjudged, metric, n_gated, passes, n_iterations, since_accept, exhausted
        ("done", 120, 0, 0.95, 50, True, 0, 0, False), ("done", 100, 0, 0.5, 50, False, 30, 30, False),
        ("tune", 90, 0, 0.5, 50, False, 2, 2, False), ("tune", 95, 0, 0.5, 50, False, 2, 2, True),
        ("stuck", 90, 0, None, None, None, 0, 0, False), ("stuck", 90, 0, 0.1, 5, False, 2, 2, True),
        ("new", 0, 0, None, None, None, 0, 0, False),
    ]
    frame = spark.createDataFrame(models, "field_name string, refs long, unjudged long, metric double, n_gated long, passes boolean, n_iterations long, since_accept long, exhausted boolean")
    states = gating.gates.next_action(gating.field_states(frame))
    assert {r.field_name: (r.refs, r.n_evaluated, r.n_below, r.n_optimizable, r.n_flagged, r.best_passes, r.action) for r in states.collect()} == {
        "done": (100, 2, 1, 0, 1, True, "done"), "tune": (90, 2, 2, 1, 0, False, "optimize"), "stuck": (90, 1, 1, 0, 0, False, "stuck"), "new": (0, 0, 0, 0, 0, False, "extract")
    }


@pytest.fixture
def many_ranges(spark):
    """Small data would be one range otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_a_hot_group(spark, many_ranges, descending):
    rng = random.Random(1)
    points = {(g, round(rng.random(), 4)): rng.randrange(1, 9) for g in ["hot"] * 3000 + ["a", "b", None] * 40 + ["one"]}
    frame = spark.createDataFrame([(g, v, n) for (g, v), n in points.items()], "g string, v double, n long").repartition(7)
    found = {(r.g, r.v): (r.upto_n, r.whole_n) for r in ranks.running(frame, ["g"], "v", ["n"], descending).collect()}
    wanted, upto = {}, defaultdict(int)
    for (g, v), n in sorted(points.items(), key=lambda x: (x[0][0] or "", x[0][1]), reverse=descending):
        upto[g] += n
        wanted[g, v] = upto[g]
    assert found == {k: (x, upto[k[0]]) for k, x in wanted.items()}
    held = ranks.durable(frame.repartitionByRange("g", "v").withColumn("part", ranks.F.spark_partition_id()))
    assert held.where("g = 'hot'").select("part").distinct().count() > 1  # no task holds the hot group


def test_lower_middle(spark, many_ranges):
    rng = random.Random(2)
    values = {g: [rng.randrange(50) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 301), ("d", 300))}
    frame = spark.createDataFrame([(g, v) for g, x in values.items() for v in [*x, None]], "g string, v int")
    assert {r.g: r.v for r in ranks.lower_middle(frame, ["g"], "v").collect()} == {g: sorted(x)[(len(x) - 1) // 2] for g, x in values.items()}


def test_report_by_field(spark):
    report = spark.createDataFrame([("f", x, x > 0.5) for x in (0.1, 0.4, 0.4, 0.9)] + [("g", None, False), ("h", 0.3, False)], "field_name string, metric double, passes boolean")
    found = {r.field_name: (r.n_passing, r.n_models, r.best, r.worst, r.median) for r in gating.report_by_field(report).collect()}
    assert found == {"f": (1, 4, 0.9, 0.1, 0.4), "g": (0, 1, None, None, None), "h": (0, 1, 0.3, 0.3, 0.3)}
