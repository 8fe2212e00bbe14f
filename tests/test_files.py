"""Readers of files, uploads, log tails, human agreement, consensus over lists."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import gating, ranks, scoring
from assayer.sources import readers, sinks


def test_log_tail_reads_the_end_only(spark, tmp_path):
    path = tmp_path / "big.log"
    with path.open("wb") as f:
        f.write(b"start\n")
        f.seek(1 << 30)  # a file of 1 GB
        f.write("\n".join(["older", *(f"line {k} é" for k in range(40)), "", "  ", "last\r", ""]).encode())

    found = [r.value for r in readers.log_tail(spark, f"file://{path}", 20).orderBy("at").collect()]
    assert found == [*(f"line {k} é" for k in range(21, 40)), "last"]
    small = tmp_path / "small.log"
    small.write_bytes(b"one\n\ntwo\nthree")
    for block in (1, 2, 5, 64):
        tail = lambda n: [r.value for r in readers.log_tail(spark, f"file://{small}", n, block).orderBy("at").collect()]
        assert tail(2) == ["two", "three"] and tail(0) == ["three"] and tail(900) == ["one", "two", "three"]
    small.write_bytes(b"")
    assert readers.log_tail(spark, f"file://{small}", 5).count() == 0


def test_rows_are_numbered_as_they_are_read(spark):
    rows = spark.range(0, 1000, 1, 7).where("id % 3 <> 1").withColumnRenamed("id", "v")
    assert [tuple(r) for r in ranks.numbered(rows, "row").orderBy("row").collect()] == [(v, k) for k, v in enumerate(x for x in range(1000) if x % 3 != 1)]


def test_screening_upload(spark):
    cells = [
        ("7", "A study", "of x", "Lee", "2001", "include"), (" 7 ", "A study, again", None, None, None, ""), (None, "No id!", None, None, None, "EXCLUDE Wrong design (RCT)"),
        ("nan", None, "only abstract", None, None, "perhaps"), ("9", " ", "", "x", "y", "include"), ("abc", "T" * 300, None, None, None, None),
    ]
    sheet = spark.createDataFrame(cells, "u1 string, TITLE string, AB string, a1 string, Py string, TA_DECISION string").coalesce(1)
    found = {r.title[:8]: r for r in readers.screening_upload(sheet).collect()}
    ids = spark.range(1).select(*[readers.text.stable_id(F.lit(x)) for x in ("row-2", "row-3", "abc")]).first()
    again = found["A study,"]
    assert again.record_id == 7 and again.value_json == '{"decision":"INCLUDE","tag":""}' and again.file_name == "7_a_study_again.md" and again.md_text == "# A study, again\n\n"
    assert found["No id!"].record_id == ids[0] and found["No id!"].value_json == '{"decision":"EXCLUDE","tag":"wrong_design_rct","tag_label":"Wrong design (RCT)"}'
    assert found[""].record_id == ids[1] and found[""].value_json == '{"decision":"MAYBE","tag":"","raw":"perhaps"}' and found[""].md_text == "# \n\n## Abstract\n\nonly abstract\n"
    assert found["T" * 8].record_id == ids[2] and len(found["T" * 8].title) == 255 and found["T" * 8].value_json is None and len(found) == 4


def test_taxonomy_and_roster(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"countries": ["Peru"],\n "sectors": ["Health"], "sub_sectors_by_sector": {"Health": ["Clinics", "Care"]}}')
    found = {tuple(r) for r in readers.taxonomy(spark, f"file://{tmp_path}/t.json").collect()}
    assert found == {("countries", None, "Peru"), ("sectors", None, "Health"), ("sub_sectors", "Health", "Clinics"), ("sub_sectors", "Health", "Care")}
    pytest.importorskip("yaml")
    assert {tuple(r) for r in readers.model_roster(spark, "small:\n  - a/b\n  - id: c\nlarge: []\n").collect()} == {("a/b", "small"), ("c", "small")}


def test_subset(spark):
    tables = {"records": spark.range(5).withColumnRenamed("id", "record_id"), "prompts": spark.range(3)}
    found = sinks.subset(tables, spark.createDataFrame([(1,), (1,), (9,)], "record_id long"), "record_id")
    assert [r.record_id for r in found["records"].collect()] == [1] and found["prompts"].count() == 3


def test_human_agreement(spark):
    pairs = [("region", ["a"] if k % 2 else ["b"], ["a"] if k % 2 else ["b"] if k else ["a"]) for k in range(40)] + [("region", [], ["a"]), ("countries", ["x", "y"], ["x"]), ("countries", None, ["x"]), ("free", ["a"], ["a"])]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "run_id long, field_name string, predicted array<string>, truth array<string>")
    best = spark.createDataFrame([("region", "m1", 0.90), ("region", "m2", 0.5), ("countries", "m1", 0.01), ("countries", "m2", None)], "field_name string, model_id string, metric double")
    found = {r.field_name: r for r in gating.human_agreement(frame, {"region": "single_categorical", "countries": "list_categorical", "free": "single_categorical"}, best).collect()}
    assert found["region"].n == 40 and found["region"].human == pytest.approx(39 / 40) and found["region"].low < 0.90 and found["region"].verdict == "model within human range" and found["region"].model_id == "m1"
    assert found["countries"].n == 1 and found["countries"].human == pytest.approx(2 / 3) and found["countries"].verdict == "model below human" and found["countries"].gap == pytest.approx(2 / 3 - 0.01)
    assert found["free"].verdict == "no model runs"


def consensus(samples, same):
    clusters = []
    for v in samples:
        for c in clusters:
            if same(v, c[0]):
                c.append(v)
                break
        else:
            clusters.append([v])
    top = max(clusters, key=len)
    return top[0], len(top) / len(samples)


def test_consensus_over_lists(spark):
    """Lists of the same values in any order and letters are alike; so is a text that names the same."""
    rng = random.Random(5)
    base = [["a", "b", "c"], ["B", "c", "A"], ["a", "b"], [], ["d"], ["a", "b", "c", "x"]]

    def same(v, head):
        p, t = [x.lower() for x in v], [x.lower() for x in head]
        if not p or not t:
            return not p and not t
        tp = sum(min(p.count(x), t.count(x)) for x in set(p))
        return 2 * tp / (len(p) + len(t)) >= 0.9

    samples = [(k, n, rng.choice(base)) for k in range(30) for n in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame(samples, "record_id long, n long, answer array<string>")
    found = {r.record_id: (r.modal_value, r.agreement, r.n_samples) for r in scoring.consensus(frame, ["record_id"], "n", "answer", "countries", "list_categorical").collect()}
    for k in range(30):
        own = [v for i, _, v in samples if i == k]
        assert found[k] == (*consensus(own, same), len(own))
    named = spark.createDataFrame([(1, 1, ["Okoro, Ada"]), (1, 2, ["Ada Okoro"]), (1, 3, ["Lee, Kim"]), (2, 1, None), (2, 2, ["x"])], "record_id long, n long, answer array<string>")
    told = {r.record_id: (r.modal_value, r.agreement) for r in scoring.consensus(named, ["record_id"], "n", "answer", "authors", "list_text").collect()}
    assert told == {1: (["Okoro, Ada"], pytest.approx(2 / 3)), 2: (None, 0.5)}


def test_optimizer_health_counts_the_tasks_of_its_kind(spark, tmp_path):
    import datetime

    from assayer.plans import file_queries

    at = lambda h: datetime.datetime(2024, 1, 2) - datetime.timedelta(hours=h)
    orders = [(1, 0, "F", at(0), "1-URGENT", 1.0), (2, 3, "F", at(2), "2-HIGH", 1.0), (3, 1, "F", at(1), "2-HIGH", 1.0), (4, 3, "F", at(30), "1-URGENT", 1.0), (5, 3, "O", at(1), "2-HIGH", 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = file_queries.optimizer_health(spark, str(tmp_path)).first()
    assert row.asDict() == {"n_runs": 2, "n_failed": 1, "n_candidates": 2, "n_accepted": 1, "failure_rate": 0.5, "accept_rate": 0.5}
