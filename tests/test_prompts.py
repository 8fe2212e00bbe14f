"""Prompt texts: narrowing, budgets, judges' questions, cases."""

from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import prompts


def taxonomy(spark):
    sectors = spark.createDataFrame([(2, "Health", None), (1, "Farming, fishing & forestry", "work on the land"), (3, "Empty", "")], "ordinal int, sector string, definition string")
    subs = spark.createDataFrame([("Health", 2, "Hospitals"), ("Health", 1, "Clinics"), ("Farming, fishing & forestry", 1, "Crops")], "sector string, ordinal int, sub string")
    return sectors, subs


def test_extraction_prompts(spark):
    fields = [("a", "Find a.", "single_categorical", "sub_sectors", None, None), ("b", "Find b.", "single_categorical", "sectors", None, 5), ("c", "Find c.", "list_text", "none", None, None), ("d", "Find d.", "list_categorical", "flat", ["x", "y"], None)]
    fields = spark.createDataFrame(fields, "field_name string, description string, kind string, allowed string, options array<string>, max_chars int")
    papers = [
        (1, "a", "T", "body", "farming fishing FORESTRY", None), (2, "a", "T", "body", "Health!", "Use {braces}."), (3, "a", "T", "body", "Mining", None), (4, "a", "T", "body", None, None),
        (5, "b", None, "x" * 50, None, None), (6, "c", "T", None, None, None), (7, "d", "T", "é" * 20_000, None, None), (8, "a", "T", "body", "Empty", None),
    ]
    papers = spark.createDataFrame(papers, "id int, field_name string, title string, text string, context_value string, instruction string")
    contracts = {"single_categorical": "\nONE\n", "list": "\nMANY\n"}
    found = {r.id: r.prompt for r in prompts.extraction_prompts(papers, fields, *taxonomy(spark), contracts).collect()}
    head = "PAPER TITLE: T\n\n<paper>\nbody\n</paper>\n"
    grouped = prompts.GROUPED + "  Farming, fishing & forestry: Crops\n  Health: Clinics, Hospitals\n  Empty: \n"
    narrowed = lambda context, *subs: prompts.NARROWED[0] + context + prompts.NARROWED[1] + "".join(f"  {s}\n" for s in subs)
    assert found[1] == head + narrowed("farming fishing FORESTRY", "Crops") + "\nTASK: Find a.\n\nONE\n"  # case and punctuation don't count
    assert found[2] == head + narrowed("Health!", "Clinics", "Hospitals") + "\nTASK: Use {braces}.\n\nONE\n"
    assert found[3] == found[4] == head + grouped + "\nTASK: Find a.\n\nONE\n"
    assert found[5] == "PAPER TITLE: \n\n<paper>\nxxxxx\n</paper>\n" + prompts.DEFINED + "  Farming, fishing & forestry: work on the land\n  Health\n  Empty\n\nTASK: Find b.\n\nONE\n"
    assert found[6] == "PAPER TITLE: T\n\n<paper>\n\n</paper>\n\nTASK: Find c.\n\nMANY\n"
    assert "é" * 10_000 + "\n</paper>" in found[7] and "é" * 10_001 not in found[7] and "verbatim):\nx, y\n\nTASK" in found[7]
    assert found[8] == head + narrowed("Empty") + "\nTASK: Find a.\n\nONE\n"


def test_judge_questions(spark):
    rows = spark.createDataFrame([(1, 'José  "X"', "Lima|  Cusco "), (2, None, "López"), (3, "JosÃ©", "a|")], "id int, p string, t string")
    shown = rows.withColumn("t", text.display_fold("t"))
    ask = prompts.judge_prompt(F.lit("City"), F.lit("where"), prompts.json_value(F.col("p")), prompts.json_value(F.col("t")), text.alternatives(F.col("t")))
    found = {r.id: r.q for r in shown.select("id", ask.alias("q")).collect()}
    end = "\n\nIs the predicted value correct?"
    assert found[1] == 'Field: City (where)\nPredicted value: "Jose \\"X\\""\nGround truth value (ANY ONE of these is acceptable): ["Lima", "Cusco"]' + end
    assert found[2] == 'Field: City (where)\nPredicted value: null\nGround truth value: "Lopez"' + end
    assert found[3].startswith('Field: City (where)\nPredicted value: "Jose"\n')


def test_shown_lists(spark):
    rows = spark.createDataFrame([(1, ["José", "b", None, "b"]), (2, []), (3, None), (4, ["José", "b", None, "b"])], "id int, v array<string>")
    found = {r.id: r.j for r in prompts.shown_lists(rows, "v").select("id", prompts.json_list(F.col("v")).alias("j")).collect()}
    assert found == {1: '["Jose", "b", null, "b"]', 2: "[]", 3: None, 4: '["Jose", "b", null, "b"]'}


def test_cases(spark):
    cases = [("m", k, k % 2 == 0, '"p"', '"t"', "why" if k % 3 else None, "said so" if k > 5 else None) for k in range(30)] + [("n", 1, True, '"p"', '"t"', None, None)]
    frame = spark.createDataFrame(cases, "g string, id int, is_correct boolean, predicted_json string, truth_json string, explanation string, excerpt string")
    found = {r.g: r for r in prompts.case_lists(frame, ["g"], "id", 3).collect()}
    assert found["m"].failures.split("\n") == ['- record 1: predicted="p", expected="t" (why); excerpt cited: null', '- record 3: predicted="p", expected="t" (); excerpt cited: null', '- record 5: predicted="p", expected="t" (why); excerpt cited: null']
    assert found["m"].successes.split("\n")[-1] == '- record 4: correctly produced "p" (expected "t")'
    assert found["n"].failures == prompts.NO_FAILURES
    tried = spark.sql("SELECT array(named_struct('instruction', 'x', 'diagnosis', 'y'), named_struct('instruction', 'z', 'diagnosis', null)) AS a")
    assert tried.select(prompts.avoided(F.col("a"))).first()[0] == '1. "x" — diagnosis was: y\n2. "z" — diagnosis was: (none)'
