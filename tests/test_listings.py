"""Worked examples, listings and reports on small cases of their own."""

from pyspark.sql import functions as F

from assayer.functions import exemplars, models
from assayer.operators import listings, reports, sampling


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_examples_round_trip_and_odd_blocks(spark):
    prompt = 'Choose.\n\n---FEW-SHOT EXAMPLES---\nPaper: "A "quoted" trial"\nAnswer: Roads\n---\nPaper: only a paper\n---\n\nPaper: second\nAnswer:  Water \n---  \n'
    got = one(spark, exemplars.base(F.lit(prompt)).alias("b"), exemplars.parse(F.lit(prompt)).alias("p"), exemplars.parse(F.lit("plain  ")).alias("none"), exemplars.base(F.lit("plain  ")).alias("same"))
    assert got.b == "Choose." and got.same == "plain  " and got.none == []
    assert [tuple(x) for x in got.p] == [('A "quoted" trial', "Roads"), ("second", "Water")]
    again = one(spark, exemplars.parse(exemplars.serialise(F.lit("Choose."), exemplars.parse(F.lit(prompt)))).alias("p"))
    assert again.p == got.p


def test_examples_legal_and_merged(spark):
    pair = lambda p, a: exemplars.example(F.lit(p), F.lit(a))
    given = F.array(pair("x" * 300, "Roads"), pair("line\nbreak", " roads "), pair("y", "Bridges"), pair("", "Roads"))
    got = one(spark, exemplars.legal(given, F.array(F.lit("roads"))).alias("some"), exemplars.legal(given, F.lit(None).cast("array<string>")).alias("all"))
    assert [(len(x.paper), x.answer) for x in got.some] == [(200, "Roads"), (10, "roads")] and len(got.all) == 3
    merged = one(spark, exemplars.merge(F.array(pair("A", "b")), F.array(pair(" a", "B "), *[pair(str(i), "b") for i in range(9)])).alias("m"))
    assert [x.paper for x in merged.m] == ["A", "0", "1", "2", "3", "4"]


def test_parameters_take_the_first_part(spark):
    got = rows(spark, [("x/DEEPSEEK-v4-flash",), ("deepseek",), ("none",), (None,)], "m string").select(models.parameters(F.col("m"))["total"].alias("t"), models.judge_of_other_family(F.col("m"), ["deep"], "a", "b").alias("j")).collect()
    assert [(r.t, r.j) for r in got] == [(30.0, "b"), (671.0, "b"), (70.0, "a"), (70.0, "a")]


def test_decoded_values(spark):
    got = rows(spark, [('"a"',), ("a b",), ("[1,2]",), ("",), (None,)], "v string").select(listings.decoded(F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == ["a", "a b", "[1,2]", "", None]


def test_user_order_puts_nulls_last(spark):
    table = rows(spark, [(1,), (None,), (3,)], "v int")
    assert [r.v for r in table.orderBy(listings.user_order("v", True)).collect()] == [3, 1, None]
    assert [r.v for r in table.orderBy(listings.user_order("v", False)).collect()] == [1, 3, None]


def test_created_projects_need_a_free_valid_slug(spark):
    new = rows(spark, [("good-one", None), ("Bad", None), ("a", None), ("taken", None)], "slug string, config string")
    made = listings.created(new, rows(spark, [("taken",)], "slug string"))
    assert [r.slug for r in made.collect()] == ["good-one"]
    assert listings.baseline_prompts(made, rows(spark, [], "slug string, field_name string")).count() == 0


def test_unknown_version_gives_no_rows(spark):
    runs, known = rows(spark, [(1, 1), (2, 2)], "run_id int, version int"), rows(spark, [(1,), (2,)], "version int")
    assert [listings.of_version(runs, known, asked).count() for asked in (None, 2, 7)] == [2, 1, 0]


def test_exhausted_looks_at_rejected_children_of_the_same_model(spark):
    prompts = rows(spark, [(1, None), (2, 1), (3, 1)], "prompt_id int, parent_id int")
    tried = rows(spark, [("m", 2, False), ("n", 3, True)], "model_id string, prompt_id int, accepted boolean")
    got = listings.exhausted(rows(spark, [("m", 1), ("n", 1)], "model_id string, prompt_id int"), tried, prompts)
    assert {(r.model_id, r.exhausted) for r in got.collect()} == {("m", True), ("n", False)}


def test_verdicts(spark):
    raw = ['{"correct": true}', '{"correct": "no"}', '{"correct": ""}', '{"correct": 0}', '{"correct": null}', '{"correct": []}', '{"right": true}', "nothing", None]
    got = rows(spark, [(r,) for r in raw], "raw string").select(reports.verdict(F.col("raw")).alias("v")).collect()
    assert [r.v for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, None, None, None]


def test_replay_stops_after_four_rejections(spark):
    steps = rows(spark, [("r", i, i == 2) for i in range(1, 10)], "run string, step int, improves boolean")
    got = reports.replayed(steps, ["run"], "step").orderBy("step").collect()
    assert [(r.step, r.misses, r.bold) for r in got] == [(1, 0, False), (2, 1, False), (3, 0, False), (4, 1, False), (5, 2, True), (6, 3, True)]
    assert got[-1].stops


def test_proposals_take_the_first_readable_reply(spark):
    replies = rows(spark, [(1, 1, 1, "no"), (1, 1, 2, '{"instruction": " b "}'), (1, 2, 1, '{"instruction": "c"}'), (2, 1, 4, '{"instruction": "late"}')], "id int, reflector int, attempt int, raw string")
    assert [tuple(r) for r in reports.proposals(replies, ["id"], "instruction").collect()] == [(1, "b", 1, 2)]


def test_splits_of_few_rows(spark):
    few = spark.range(10)
    assert sampling.split_validation(few, "id", 1, 0.5).where("part = 'val'").count() == 0
    assert sampling.split_validation(spark.range(11), "id", 1, 0.01).where("part = 'val'").count() == 1
    parts = {r["part"]: r["count"] for r in sampling.split_fractions(few, "id", 1, 0.2, 0.1).groupBy("part").count().collect()}
    assert parts == {"test": 2, "val": 1, "train": 7}


def test_limits_look_ups_and_folded_sets(spark):
    import pytest

    from assayer.operators import listings

    rows = spark.range(3000).withColumnRenamed("id", "n")
    assert [listings.newest(rows, ["n"], asked).count() for asked in (None, 0, 5, 99_999)] == [200, 1, 5, 2000]
    assert listings.newest(rows, ["n"], 1).first().n == 2999
    projects = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, slug string")
    assert listings.by_slug(projects, "b").first().id == 2
    with pytest.raises(LookupError, match="nowhere"):
        listings.by_slug(projects, "nowhere")
    ids = spark.createDataFrame([(3,), (1,), (1,), (9,)], "id int")
    assert [r.id for r in listings.with_ids(projects, ids, "id").collect()] == [1, 3]
    lists = spark.createDataFrame([(["A", "b", "a", " c"], ["B", "x"])], "v array<string>, o array<string>")
    assert lists.select(listings.not_in("v", "o")).first()[0] == ["A", " c"]


def test_optimizer_steps_and_epsilon(spark):
    from assayer.operators import gates, reports

    fields = spark.createDataFrame([("authors",), ("sector_name",)], "f string")
    assert [r[0] for r in fields.select(gates.epsilon(fields.f)).collect()] == [0.03, 0.01]
    best = spark.createDataFrame([("r", 1, True), ("r", 3, False)], "run string, step int, improves boolean")
    steps = spark.createDataFrame([("r", k) for k in (1, 2, 2, 3, 4, 5, 6)], "run string, step int")
    found = reports.replayed(reports.with_all_steps(best, steps, ["run"], "step"), ["run"], "step")
    assert sorted((r.step, r.improves, r.misses, r.bold, r.stops) for r in found.collect()) == [
        (1, True, 0, False, False), (2, False, 0, False, False), (3, False, 1, False, False), (4, False, 2, True, False), (5, False, 3, True, True)
    ]


def test_retried_pairs(spark):
    from assayer.operators import scoring

    runs = spark.createDataFrame([(1, "a", "e"), (1, "a", "e"), (2, "a", "e"), (2, "a", None), (3, "a", "e"), (4, "a", "e")], "record_id int, model_id string, error string")
    replies = spark.createDataFrame([(1, "a", 'ok {"value": "Peru"}', "peru"), (2, "a", '{"value": "x"}', "x"), (3, "a", "sorry", "x"), (4, "a", '{"value": ""}', "x")], "record_id int, model_id string, raw string, truth string")
    found = {r.record_id: (r.predicted, r.error, r.result and r.result.outcome) for r in scoring.retried(runs, replies, ["record_id", "model_id"]).collect()}
    assert found == {1: ("Peru", None, "hit"), 3: (None, "no JSON object in the reply", None), 4: (None, None, "abstain_miss")}


def test_imbalance_and_health(spark):
    import datetime

    from pyspark.sql import functions as F

    from assayer.operators import summaries, workflow

    rows = spark.createDataFrame([("b",)] * 4 + [("a",)] * 4 + [(None,)] * 2, "v string")
    assert tuple(summaries.imbalance(rows, "v").first()) == (2, "a", 0.4, False)
    assert summaries.imbalance(rows.where("v IS NULL"), "v").count() == 0
    at = lambda h: datetime.datetime(2024, 1, 2) - datetime.timedelta(hours=h)
    tasks = spark.createDataFrame([("optimization", "done", at(1)), ("optimization", "failed", at(23)), ("optimization", "failed", at(25)), ("judge", "failed", at(1)), ("optimization", "running", None)], "kind string, status string, finished_at timestamp")
    tried = spark.createDataFrame([(at(1), True), (at(2), False), (at(30), True)], "created_at timestamp, accepted boolean")
    row = workflow.optimizer_health(tasks, tried, F.lit(at(0))).first()
    assert row.asDict() == {"n_runs": 2, "n_failed": 1, "n_candidates": 2, "n_accepted": 1, "failure_rate": 0.5, "accept_rate": 0.5}
    none = workflow.optimizer_health(tasks.limit(0), tried.limit(0), F.lit(at(0))).first()
    assert none.failure_rate == none.accept_rate == 0.0


def test_merged_examples_come_from_more_than_one_task(spark):
    from assayer.functions import exemplars
    from assayer.plans import listing_queries

    assert listing_queries.merged_exemplars(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1  # a table of one file
    lists = "array<struct<paper:string,answer:string>>"
    row = spark.createDataFrame([([("A ", "x"), ("b", "Y")], [("a", "X"), ("b", "z"), (" B", "y "), ("c", "z"), ("d", "z")])], f"kept {lists}, proposed {lists}")
    merged = lambda most: [tuple(x) for x in row.select(exemplars.merge(F.col("kept"), F.col("proposed"), most)).first()[0]]
    assert merged(6) == [("A ", "x"), ("b", "Y"), ("b", "z"), ("c", "z"), ("d", "z")]
    assert merged(3) == [("A ", "x"), ("b", "Y"), ("b", "z")]
