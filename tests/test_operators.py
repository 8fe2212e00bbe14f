"""Metrics, scoring, gates, sampling, reference data and mutations, on numbers worked out by hand."""

import math

import pytest
from assayer.config import T
from assayer.operators import gates, ground_truth, metrics, sampling, scoring, summaries, workflow
from assayer.sources import readers, sinks
from pyspark.sql import functions as F


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema).coalesce(1)


PAIRS = "id long, g string, predicted string, truth string"


def pairs(spark, *found):
    return rows(spark, [(i, "g", p, t) for i, (p, t) in enumerate(found)], PAIRS)


def test_kappa(spark):
    k = lambda *x: metrics.kappa(pairs(spark, *x), ["g"]).first()
    assert k(("a", "a"), ("b", "b")).kappa == 1.0
    assert k(("b", "a"), ("a", "b")).kappa == -1.0
    assert k(("a", "a"), ("a", "a")).kappa is None
    assert k((None, "a"), ("a", "a"), ("b", "b")).n == 3
    assert k(("a", None)) is None


def test_collapse_fails_the_floor(spark):
    collapsed = pairs(spark, *[("common", "common")] * 20, *[("common", "rare")] * 5)
    found = metrics.one_vs_rest(metrics.confusion_cells(collapsed, ["g"], "id"), ["g"]).first()
    assert (found.sensitivity, found.sensitivity_gateable, found.n_undersampled) == (0.5, True, 0)
    assert found.sensitivity < T.sensitivity_floor
    thin = metrics.one_vs_rest(metrics.confusion_cells(pairs(spark, ("a", "a"), ("b", "b"), ("c", "c")), ["g"], "id"), ["g"]).first()
    assert (thin.sensitivity_gateable, thin.n_undersampled) == (False, 3)


def test_confusion_overflow(spark):
    data = [(f"c{i}", f"c{i}") for i in range(14)] + [(None, "c0"), ("zz", "c1")]
    cells = {(r.truth_label, r.predicted_label): r.n for r in metrics.confusion_cells(pairs(spark, *data), ["g"], "id").collect()}
    assert cells[("(other)", "(other)")] == 2 and cells[("c0", "(none)")] == 1 and cells[("c1", "(other)")] == 1
    assert ("c11", "c11") in cells and ("c12", "c12") not in cells


def test_list_metrics(spark):
    table = rows(spark, [(["a", "c"], ["a", "b"])], "predicted array<string>, truth array<string>")
    found = metrics.list_metrics(table, [], 10).first()
    assert (found.tp, found.fp, found.fn, found.precision, found.recall, found.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert found.specificity == 7 / 8
    twice = rows(spark, [(["a", "a", "b"], ["a", "b", "b"]), ([], ["x", "y"])], "predicted array<string>, truth array<string>")
    assert (lambda r: (r.tp, r.fp, r.fn))(metrics.list_metrics(twice, []).first()) == (2, 1, 3)


def test_fbeta_and_wilson(spark):
    one = spark.range(1)
    assert one.select(metrics.fbeta(F.lit(0.0), F.lit(0.0))).first()[0] == 0.0
    low, high = metrics.wilson(F.lit(0.5), F.lit(100))
    got = one.select(low, high).first()
    assert math.isclose(got[0], 0.403832, abs_tol=1e-5) and math.isclose(got[1], 0.596168, abs_tol=1e-5)
    low, high = metrics.wilson(F.lit(0.5), F.lit(0))
    assert tuple(one.select(low, high).first()) == (None, None)


def test_calibration_bins(spark):
    runs = rows(spark, [("m", 1.0, True), ("m", 0.2, False), ("m", 0.19, True)], "model_id string, confidence double, is_correct boolean")
    found = {r.bin: r.n for r in metrics.calibration_bins(runs, ["model_id"]).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_work_saved_share(spark):
    curve = rows(spark, [("m", 20.0, 100.0), ("m", 60.0, 80.0), ("m", 100.0, 60.0)], "model_id string, share_pct double, accuracy_pct double")
    at = lambda t: metrics.share_at(curve, ["model_id"], t).first().share_pct
    assert (at(90.0), at(50.0), at(101.0)) == (40.0, 100.0, 0.0)


def test_single_scores(spark):
    data = [("Health", "health"), (None, None), ("x", None), (None, "x"), ("b", "a|b"), ("Education", "Secondary education"), ("no", "yes"), ("a, b, and c", "a, b and c")]
    table = rows(spark, [(i, p, t) for i, (p, t) in enumerate(data)], "id int, predicted string, truth string")
    found = {r.id: (r.result.score, r.result.outcome, r.result.honesty_score) for r in scoring.single(table).collect()}
    assert found == {
        0: (1.0, "hit", 1.0), 1: (1.0, "correct_abstain", 1.0), 2: (0.0, "hallucination", 0.0), 3: (0.0, "abstain_miss", 0.5),
        4: (1.0, "hit", 1.0), 5: (0.9, "hit", 0.9), 6: (0.0, "wrong", 0.0), 7: (1.0, "hit", 1.0),
    }


def test_list_scores(spark):
    data = [(["a", "b"], ["a", "b"]), (["a"], ["a", "b"]), (["a", "x"], ["a", "b"]), ([], []), (["a"], []), (None, ["a"]), (["USA"], ["United States"])]
    table = rows(spark, [(i, p, t) for i, (p, t) in enumerate(data)], "id int, predicted array<string>, truth array<string>")
    found = {r.id: (round(r.result.score, 4), r.result.outcome, round(r.result.honesty_score, 4)) for r in scoring.lists(table, "author_country", False, ["United States"]).collect()}
    assert found == {
        0: (1.0, "hit", 1.0), 1: (0.6667, "abstain_miss", 0.8571), 2: (0.5, "wrong", 0.6), 3: (1.0, "correct_abstain", 1.0),
        4: (0.0, "hallucination", 0.0), 5: (0.0, "abstain_miss", 0.5), 6: (1.0, "hit", 1.0),
    }
    near = rows(spark, [(1, ["university of oxfrd", "zz"], ["University of Oxford"])], "id int, predicted array<string>, truth array<string>")
    got = scoring.lists(near, "author_affiliation", True).first()
    assert (got.tp, got.extra, got.missing) == (1, ["zz"], [])


def test_excerpts(spark):
    data = [(1, "The Cat", "see the  cat sit"), (2, "", "x"), (3, "quick brown fox jumps", "a quick brown fux jumps high"), (4, "nothing alike", "zzzz")]
    found = {r.id: r.verified for r in scoring.verify_excerpts(rows(spark, data, "id int, excerpt string, source string"), "excerpt", "source").collect()}
    assert found == {1: True, 2: None, 3: True, 4: False}


def test_screening(spark):
    data = [("INCLUDE", "", "include", ""), ("EXCLUDE", "design", "exclude", "study design"), ("EXCLUDE", "x", "exclude", ""), ("MAYBE", "", "include", ""), ("INCLUDE", "", "exclude", "")]
    got = rows(spark, data, "d string, t string, gd string, gt string").select(scoring.screening(F.col("d"), F.col("t"), F.col("gd"), F.col("gt")).alias("s")).collect()
    assert [(r.s.score, r.s.outcome) for r in got] == [(1.0, "correct"), (1.0, "correct"), (1.0, "correct_wrong_tag"), (0.5, "maybe_vs_include"), (0.0, "wrong_include_vs_exclude")]


@pytest.mark.parametrize(("n", "since", "best", "status"), [(4, 4, 0.5, "optimize"), (5, 3, 0.5, "task_limited"), (5, 3, 0.86, "plateaued"), (25, 0, 0.5, "budget"), (10, 2, 0.5, "optimize")])
def test_stop_rule(spark, n, since, best, status):
    assert spark.range(1).select(gates.stop_status(F.lit(n), F.lit(since), F.lit(best), F.lit(0.9))).first()[0] == status


def test_splits_are_disjoint(spark):
    part = {r["part"]: r["count"] for r in sampling.split(spark.range(100), "id", 1, 50, 40).groupBy("part").count().collect()}
    assert part == {"holdout": 33, "val": 33, "train": 34}
    assert sampling.split(spark.range(100), "id", 1, 50, 40).select("id").distinct().count() == 100
    picked = sampling.round_robin(rows(spark, [(i, "ab"[i % 7 == 0]) for i in range(20)], "id int, s string"), "s", "id", 4, 1)
    assert {r.s: r["count"] for r in picked.groupBy("s").count().collect()} == {"a": 2, "b": 2}


def test_reviews(spark):
    got = rows(spark, [("keep",), ("Accept ",), ("edit: New",), ("Other",), (None,)], "c string").select(ground_truth.decision(F.col("c")).alias("d")).collect()
    assert [(r.d.kind, r.d.value) for r in got] == [("keep", None), ("accept", None), ("edit", "New"), ("edit", "Other"), ("", None)]
    truth = rows(spark, [(1, ["a", "b b"])], "record_id long, values array<string>")
    reviews = rows(
        spark,
        [(1, 1, "recall_miss", "a", "accept"), (1, 2, "models_agree_gt_lacks", "c", "accept"), (1, 3, "recall_miss", "b b", "edit: d"), (1, 4, "models_agree_gt_lacks", "C", "accept")],
        "record_id long, ordinal int, issue_type string, value string, curator_decision string",
    )
    plan = ground_truth.plan_lists(reviews, truth).first()
    assert (plan.new, plan.ops) == (["d", "c"], ["remove: a", "add: c", "replace: b b -> d"])


def test_audit_and_proposals(spark):
    truth = rows(spark, [(1, ["Smith, J", "Smith, J"]), (2, []), (3, ["José X"])], "record_id long, values array<string>")
    allowed = rows(spark, [("Smith, J",), ("Health care",)], "value string")
    found = {(r.issue, r.record_id) for r in ground_truth.audit(truth, allowed).collect()}
    assert {("duplicate_entry", 1), ("empty", 2), ("encoding_noise", 3), ("name_order", 3), ("not_in_taxonomy", 3)} <= found
    values = rows(spark, [("health  care",), ("care of health",), ("Healthcare",), ("a|b",)], "value string")
    got = {r.value: r.action for r in ground_truth.propose(values, allowed).collect()}
    assert got == {"health  care": "valid", "care of health": "remap", "Healthcare": "review", "a|b": "manual_pick"}


def test_queue(spark):
    tasks = rows(spark, [(1, "k", 1, "pending", 1), (2, "k", 2, "running", 5), (3, "k", 3, "pending", 9), (4, "k", 4, "done", 9)], "task_id long, kind string, args long, status string, priority int")
    assert [r.task_id for r in workflow.next_tasks(tasks, 5).collect()] == [3, 1]
    new = rows(spark, [("k", 2), ("k", 4), ("k", 4), ("z", 1)], "kind string, args long")
    assert sorted((r.kind, r.args) for r in workflow.enqueue(tasks, new).collect()) == [("k", 4), ("z", 1)]


def test_mutations(spark, tmp_path):
    old = rows(spark, [(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, sinks.upsert(old, rows(spark, [(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.insert_missing(old, rows(spark, [(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    sinks.json_lines(rows(spark, [("é ", None)], "t string, n int"), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first().value == '{"t":"é ","n":null}'
    got = readers.json_lines(spark, f"{tmp_path}/j", "t string, n int").collect()
    assert [(r.t, r.n) for r in got] == [("é ", None)]


def test_uploads(spark, tmp_path):
    assert readers.upload_kind(["record_id", "field_name", "value"]) == "extraction"
    with pytest.raises(ValueError, match="decision"):
        readers.upload_kind(["record_id", "x"])
    (tmp_path / "u.csv").write_text("﻿U1,T1,Decision\n7,Title,include\n8,,exclude\n", encoding="utf-8")
    table = readers.csv_table(spark, str(tmp_path / "u.csv"))
    assert [(r.raw_id, r.decision) for r in readers.screening_records(table).collect()] == [("7", "include")]
    assert readers.decision_column(table) == "Decision"
    (tmp_path / "12.md").write_text("x")
    (tmp_path / "notes.md").write_text("y")
    assert [(r.record_id, r.text) for r in readers.markdown_records(spark, str(tmp_path)).collect()] == [(12, "x")]


def test_summaries(spark):
    runs = rows(spark, [("m", "r", None), ("m", "s", "e"), ("n", "r", "e")], "model_id string, record_id string, error string")
    assert [r.model_id for r in summaries.all_failed(runs, ["model_id"]).collect()] == ["n"]


def test_nearest_equals_the_cross_join(spark):
    import random

    from assayer.functions import fuzzy
    from assayer.operators import nearest

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    options = list(dict.fromkeys([" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["", "a", "ab"]))
    values = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)]
    for t in rng.sample(options, 150):  # near ones
        at = rng.randrange(len(t) + 1)
        values.append(t[:at] + rng.choice(["", "x", "yy"]) + t[at + rng.randint(0, 2) :])
    values = list(dict.fromkeys([*values, "", "zzzz", "1 2 3", "é"]))
    found = nearest.nearest(rows(spark, [(v, v) for v in values], "value string, text string"), rows(spark, list(enumerate(options)), "rank long, text string"))
    wanted = {}
    for v in values:
        score, less = max((fuzzy.ratio(v, t), -k) for k, t in enumerate(options))
        wanted[v] = (-less, score)
    assert {r.value: (r.rank, r.score) for r in found.collect()} == wanted
    none = nearest.nearest(rows(spark, [("a", "a")], "value string, text string"), rows(spark, [], "rank long, text string"))
    assert none.collect() == []


def test_nearest_goes_on_only_where_an_option_may_be_nearer(spark, monkeypatch):
    from assayer.operators import nearest

    counts, durable = [], nearest.durable

    def counting(df):
        table = durable(df)
        counts.append(table.where("rank IS NULL").count() if "guess" in table.columns else 0)
        return table

    monkeypatch.setattr(nearest, "durable", counting)
    options = [f"supplier#{k:09d}" for k in range(400)] + ["é", "supplier#000000"]
    values = [f"suplier#{k:09d}" for k in range(400)] + [f"limited supplier#{k:09d}" for k in range(400)] + ["supplier#00000"]
    found = nearest.nearest(rows(spark, [(v, v) for v in values], "value string, text string"), rows(spark, list(enumerate(options)), "rank long, text string"))
    assert {r.value: r.rank for r in found.collect()} == {v: k % 400 for k, v in enumerate(values[:-1])} | {"supplier#00000": 401}
    assert len(counts) > 3 and max(counts) <= len(values)  # not one for each value and option


def test_list_plans_are_those_of_one_review_after_the_other(spark):
    import random

    from assayer.functions import fuzzy, text

    rng = random.Random(6)
    words = ["World Bank", "world  bank", "Bank World", "UNICEF", "Unicéf", "FAO", "Food Org", "Food Orgs", "x"]

    def matches(a, b):
        a, b = text.plain(a), text.plain(b)
        return a == b or fuzzy.token_sort(a, b) >= 90

    truth = {k: [rng.choice(words) for _ in range(rng.randrange(5))] for k in range(60)}
    reviews = [(k, n, rng.choice(["recall_miss", "models_agree_gt_lacks", "other"]), rng.choice(words), rng.choice(["keep", "accept", "", "edit: FAO", "edit:  ", "Edit: food org"])) for k in range(0, 70, 1) for n in range(rng.randrange(5))]
    wanted = {}
    for k, old in truth.items():
        work, ops = list(old), []
        for _, _, issue, value, said in sorted(r for r in reviews if r[0] == k):
            kind = "edit" if said.lower().startswith("edit:") else said
            edit = said[5:].strip() if kind == "edit" else ""
            if kind in ("keep", "") or kind == "edit" and not edit:
                continue
            target = edit or value
            at = next((i for i, x in enumerate(work) if matches(x, value)), None)
            if issue == "models_agree_gt_lacks" and not any(matches(x, target) for x in work) or issue == "recall_miss" and edit and at is None:
                work.append(target)
                ops.append(f"add: {target}")
            elif issue == "recall_miss" and at is not None:
                ops.append(f"replace: {work[at]} -> {edit}" if edit else f"remove: {work[at]}")
                work[at : at + 1] = [edit] if edit else []
        seen, new = set(), []
        for x in work:
            if text.plain(x) not in seen:
                seen.add(text.plain(x))
                new.append(x)
        if ops and new != old:
            wanted[k] = (old, new, ops)
    plan = ground_truth.plan_lists(rows(spark, reviews, "record_id long, ordinal int, issue_type string, value string, curator_decision string"), rows(spark, list(truth.items()), "record_id long, values array<string>"))
    assert {r.record_id: (r.old, r.new, r.ops) for r in plan.collect()} == wanted and wanted
