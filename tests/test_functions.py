"""Text, names, similarity and parsing."""

import pytest
from assayer.functions import fuzzy, names, parsing, text
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def column(spark, values, expression, schema="v string"):
    table = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in table.select(expression(F.col("v"))).collect()]


def test_look_up_keys(spark):
    assert column(spark, ["  U.S.A. ", "Côte d'Ivoire", "a b", None], text.lookup_key) == ["u s a", "côte d ivoire", "a b", None]


def test_normed_text(spark):
    values = ["  Søren  ÆRØ ", "cafÃ©", "Ünïcode", None, "plain"]
    assert column(spark, values, text.norm_text) == ["soren aero", "cafe", "unicode", None, "plain"]
    assert column(spark, ["a, b & c"], lambda c: text.category_fold(text.norm_text(c))) == ["a b c"]


def test_alternatives_and_lists(spark):
    assert column(spark, ["a | b||", "", None], text.alternatives) == [["a", "b"], [], []]
    assert column(spark, ['["x","y"]', '"p|q"', "null", "3"], text.value_list) == [["x", "y"], ["p", "q"], [], ["3"]]


def test_missing_values(spark):
    values = ["Not reported", "NOT SPECIFIES (consultant)", "n/a", "999", "Nonesuch University", "none"]
    assert column(spark, values, text.is_missing) == [True, True, True, True, False, True]


def test_ids_and_slugs(spark):
    assert column(spark, ["12", "12.7", "abc"], text.stable_id)[:2] == [12, 12]
    assert column(spark, ["abc"], text.stable_id) == [int("ba7816bf", 16)]
    assert column(spark, [" A-b  c! "], text.slug) == ["a_b_c"]
    assert column(spark, ["org/~model-x-latest"], text.short_model_name) == ["model-x"]
    assert column(spark, ["<html><body class='x'>\nhi", "none"], text.stripped_boilerplate) == ["\nhi", "none"]


def test_countries(spark):
    known = ["United States", "Korea, Rep.", "Korea, Dem. People's Rep.", "Congo, Dem. Rep.", "Congo, Rep.", "Egypt, Arab Rep.", "Micronesia, Fed. Sts."]
    values = ["USA", "South Korea", "Korea", "Congo", "egypt", "Micronesia", "Atlantis"]
    assert column(spark, values, lambda c: names.country(c, known)) == ["United States", "Korea, Rep.", "Korea", "Congo", "Egypt, Arab Rep.", "Micronesia, Fed. Sts.", "Atlantis"]


def test_institutions(spark):
    values = ["M.I.T.", "mit", "University of Harvard", "Oxford University", "University of WHO", "campus"]
    assert column(spark, values, names.institution) == ["M.I.T.", "Massachusetts Institute of Technology", "Harvard University", "University of Oxford", "University of WHO", "campus"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Black, R. E.", "Black, Robert E.", True), ("Smith, J.", "Smith, John", False), ("Wahed, MA", "Wahed, M. A.", True), ("Smith", "Smith, John", True),
        ("John Smith", "Smith, John", True), ("Smith, John", "Smith, Jane", False), ("Jones, A. B.", "Smith, A. B.", False), ("", "", False), ("Ana Li", "Li, A. N. A.", False),
    ],
)
def test_authors(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(names.authors_equal(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x is same


@pytest.mark.parametrize(
    ("a", "b", "token_set", "token_sort", "partial"),
    [
        ("smith, j.", "smith, john", 80.0, 80.0, 94.1), ("smith, john", "smith, john paul", 100.0, 81.5, 100.0), ("smith, john", "smith, joan", 90.9, 90.9, 90.9),
        ("university of oxford", "university of oxfrd", 97.4, 97.4, 94.7), ("education", "secondary education", 100.0, 64.3, 100.0), ("health", "education", 40.0, 40.0, 50.0),
        ("dept of economics, leibniz university of hannover", "leibniz university of hannover", 100.0, 75.9, 100.0),
    ],
)
def test_similarity(a, b, token_set, token_sort, partial):
    assert (round(fuzzy.token_set(a, b), 1), round(fuzzy.token_sort(a, b), 1), round(fuzzy.partial(a, b), 1)) == (token_set, token_sort, partial)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_by_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.lcs(a, b) == table[-1][-1]
    assert 0 <= fuzzy.ratio(a, b) <= 100


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_folds_are_idempotent(value):
    once = text.plain(value)
    assert text.plain(once) == once or not once.isascii()


def test_responses(spark):
    raw = ['x ```json\n{"value": "a"}\n``` y', 'Sure: {"value": " b "} done', "{broken", "[1]", None, '{"values": ["p", " ", "q"]}']
    assert column(spark, raw, lambda c: parsing.scalar_answer(parsing.json_object(c))) == ["a", "b", None, None, None, None]
    assert column(spark, raw, lambda c: parsing.list_answer(parsing.json_object(c)))[-1] == ["p", "q"]
    assert column(spark, ['{"decision": "include"}', '{"decision": "perhaps"}', "{}"], lambda c: parsing.screening_decision(parsing.json_object(c))) == ["INCLUDE", "MAYBE", "MAYBE"]


def test_confidences(spark):
    assert column(spark, ["0.4", "85", "150", "-1", "high", None, "NaN"], parsing.confidence) == [0.4, 0.85, 1.0, 0.0, None, None, None]


def test_uploads(spark):
    assert column(spark, ["a|b", 'say "x"', "plain"], parsing.uploaded_value) == ['["a","b"]', '"say \\"x\\""', '"plain"']
    probabilities = spark.createDataFrame([([-0.1, None, -0.3],), ([None],), (None,)], "v array<double>")
    assert [r[0] and round(r[0], 6) for r in probabilities.select(parsing.mean_probability(F.col("v"))).collect()] == [0.818731, None, None]
