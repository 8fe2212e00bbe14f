"""Scores of lists and single answers, agreement and clusters, against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import fuzzy, text
from assayer.operators import ground_truth, metrics, scoring


def scored(spark, field, is_fuzzy, *pairs):
    rows = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(pairs)], "i int, predicted array<string>, truth array<string>")
    return {r.i: r for r in scoring.lists(rows, field, is_fuzzy, ["Kenya"]).collect()}


def test_author_lists(spark):
    got = scored(
        spark, "authors", True,
        (["Adeyemi, T. O.", "Núñez, Carla"], ["Adeyemi, Tunde Oluwaseun", "Nunez, Carla"]),
        (["Brandt, K."], ["Brandt, Klaus"]),
        (["Brandt, KA", "Brandt, KA"], ["Brandt, K. A."]),
        (None, ["Brandt, K. A."]),
        (["Lone, X"], []),
        ([], None),
    )
    assert [(got[i].tp, got[i].result.outcome) for i in range(6)] == [(2, "hit"), (0, "wrong"), (1, "wrong"), (0, "abstain_miss"), (0, "hallucination"), (0, "correct_abstain")]
    assert got[2].extra == ["Brandt, KA"] and got[2].missing == [] and got[1].missing == ["Brandt, Klaus"]


def test_fuzzy_lists_match_in_order(spark):
    got = scored(spark, "author_affiliation", True, (["Institute of Soil Research, Lund", "b"], ["lund institute of soil research", "B"]), (["x y", "y x"], ["y x", "x z"]))
    assert got[0].tp == 2 and got[1].tp == 1 and got[1].extra == ["y x"]
    plain = scored(spark, "sub_sector", False, (["Crops", "crops "], ["CROPS", "fish"]))
    assert plain[0].tp == 1 and plain[0].result.score == 0.5 and plain[0].result.honesty_score == pytest.approx(0.6)


def test_penalty(spark):
    rows = spark.createDataFrame([("Maize", "Maize", False), ("Maize", "Maize", None), ("", "Maize", False), ("Rice", "Maize | rice", True)], "predicted string, truth string, excerpt_verified boolean")
    got = scoring.field_scores(rows, "sector_name", "single_categorical").select("result.score", "result.honesty_score", "result.outcome").collect()
    assert sorted(map(tuple, got)) == sorted([(1.0, 0.5, "hit"), (1.0, 1.0, "hit"), (0.0, 0.5, "abstain_miss"), (1.0, 1.0, "hit")])
    with pytest.raises(ValueError):
        scoring.field_scores(rows, "x", "other")


def test_list_metrics_fold_and_authors(spark):
    rows = spark.createDataFrame([(["Crème", "b", "b"], ["creme", "B"]), (["Diaz, M. L."], ["Díaz, M. L.", "Diaz, Mary Lou"])], "predicted array<string>, truth array<string>")
    found = metrics.list_metrics(rows, [], 10).first()
    assert (found.n, found.tp, found.fp, found.fn) == (2, 3, 1, 1) and found.specificity == pytest.approx(15 / 16)
    assert metrics.list_metrics(rows, [], None, "authors").first().tp == 3


def test_agreement_is_by_score(spark):
    rows = spark.createDataFrame([(1, "a", "Maize|Rice"), (1, "b", "rice"), (2, "a", "x"), (3, "a", "Wheat"), (3, "b", "wheat!"), (3, "c", "Rye")], "record_id long, model_id string, value string")
    got = {r.model_id: (r.agreement, r.n_records) for r in metrics.agreement(rows).collect()}
    assert got == {"a": (pytest.approx(0.25), 2), "b": (pytest.approx(0.75), 2), "c": (0.0, 1)}


def test_clusters(spark):
    rows = spark.createDataFrame([(1, 1, "Oats"), (1, 2, "rye"), (1, 3, "RYE."), (1, 4, "oats"), (1, 5, "Rye"), (2, 6, None), (2, 7, None), (2, 8, "z")], "record_id long, at long, v string")
    got = {r.record_id: (r.modal_value, r.agreement, r.n_samples) for r in scoring.consensus(rows, ["record_id"], "at", "v").collect()}
    assert got == {1: ("rye", 0.6, 5), 2: (None, pytest.approx(2 / 3), 3)}


def test_manual_pick_names_the_valid_parts(spark):
    values = spark.createDataFrame([("Soil|Moon| water",), ("x | y",)], "value string")
    allowed = spark.createDataFrame([("Soil",), ("Water",)], "value string")
    got = {r.value: (r.action, r.proposed) for r in ground_truth.propose(values, allowed).collect()}
    assert got == {"Soil|Moon| water": ("manual_pick", "Soil OR water"), "x | y": ("manual_pick", "x OR y")}


def test_folds_agree_with_the_udf(spark):
    texts = ["  A\tb\x1c c!", "Ærø\u00a0x", "", None, "a_b-c\nd", "ÃŸ é"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.norm_text("t").alias("n"), text.display_fold("t").alias("d"), text.both_folds("t").alias("f")).collect()
    for r in rows:
        want = (text.plain(r.t), None if r.t is None else text.display(r.t))
        assert (r.n, r.d) == want and (r.f.normed, r.f.shown) == want


def test_bound_never_excludes_a_match(spark):
    words = ["world health org", "world health organisation", "org world health", "healthorganisation of the world", "abcdefgh", "abcdefgx ijklmnop", "zz", "", "university of leeds", "leeds univ"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for limit in (60.0, 80.0, 95.0):
        for r in pairs.withColumn("open", fuzzy.may_be_same(F.col("a"), F.col("b"), limit)).collect():
            assert r.open or not fuzzy.same_value(r.a, r.b, limit) or r.a == r.b


@pytest.mark.parametrize("field, fuzzy", [("author_affiliation", True), ("authors", False)])
def test_lists_are_normalised_in_more_than_one_task(spark, monkeypatch, field, fuzzy):

    written, durable = [], scoring.durable

    def noting(df):
        written.append((df.columns, df.rdd.getNumPartitions()))
        return durable(df)

    monkeypatch.setattr(scoring, "durable", noting)
    lists = [([f"World Bank {k}", "none"], [f"world bank {k}"]) for k in range(40)]
    rows = spark.createDataFrame(lists, "predicted array<string>, truth array<string>").coalesce(1)
    assert scoring.lists(rows, field, fuzzy).where("tp = 1").count() == 40
    assert dict((tuple(c), n) for c, n in written)["predicted", "truth", "_p", "_t"] > 1
    assert ["p", "t"] in [c for c, _ in written]  # the judged pairs, of known size before they meet the cells
    assert rows.select(F.lit(1)).rdd.getNumPartitions() == 1
