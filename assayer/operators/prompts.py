"""Prompt texts as tables: extraction with allowed values, judging, and what a reflector is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The layout of an extraction prompt and of its lists of allowed values
PAPER = ("PAPER TITLE: ", "\n\n<paper>\n", "\n</paper>\n")
TASK = "\nTASK: "
FLAT = "\nAllowed values (choose exactly one, verbatim):\n"
DEFINED = "\nAllowed values — choose exactly one, verbatim (with definitions):\n"
GROUPED = "\nAllowed values — choose exactly one, verbatim (grouped by sector):\n"
NARROWED = ("\nAllowed values — choose exactly one, verbatim.\nThe sector has already been determined as: ", "\nChoose ONLY from the sub-sectors under this sector:\n\n")
MAX_CHARS, MOST_CASES = 10_000, 8
# The layout of a judge's question and of cases
JUDGED = ("Field: ", "\nPredicted value: ", "Ground truth value: ", "Ground truth value (ANY ONE of these is acceptable): ", "\n\nIs the predicted value correct?")
NO_FAILURES, NO_SUCCESSES = "(no failure cases in this sample)", "(no correct cases in this sample)"

#: What the reply has to look like, by the kind of value; callers have their own.
CONTRACTS = {
    "single_categorical": '\nReply with one JSON object: "excerpt" (the words that the value comes from, or null), "value" (an allowed value, or null), "confidence" (0 to 1), "notes".\n',
    "list": '\nReply with one JSON object: "excerpt" (the words that the values come from, or null), "values" (each once, or an empty list), "confidence" (0 to 1), "notes".\n',
}


def sector_key(name: Column) -> Column:
    """A sector's name without case, white space and punctuation."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\w]", "")


def option_blocks(sectors: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sectors (ordinal, sector, definition), subs (sector, ordinal, sub) -> one row (defined, grouped), and narrowed (key, lines).

    A taxonomy is a short document: its texts are one row, and one for each sector.
    """
    in_order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    of_sector = subs.groupBy("sector").agg(in_order("ordinal", "sub").alias("subs")).select("sector", F.transform("subs", lambda x: x["sub"]).alias("subs"))
    both = sectors.join(of_sector, "sector", "left").withColumn("subs", F.coalesce("subs", F.array().cast("array<string>")))
    line = F.concat(F.lit("  "), F.col("sector"), F.when(F.coalesce("definition", F.lit("")) != "", F.concat(F.lit(": "), "definition")).otherwise(""))
    group = F.concat(F.lit("  "), F.col("sector"), F.lit(": "), F.array_join("subs", ", "))
    lines = both.select("ordinal", line.alias("line"), group.alias("group"))
    whole = lambda c, head: F.concat(F.lit(head), F.array_join(F.transform(in_order("ordinal", c), lambda x: x[c]), "\n"), F.lit("\n"))
    full = lines.agg(whole("line", DEFINED).alias("defined"), whole("group", GROUPED).alias("grouped"))
    first = both.groupBy(sector_key(F.col("sector")).alias("key")).agg(F.min_by("subs", "ordinal").alias("subs"))
    narrowed = first.select("key", F.array_join(F.transform("subs", lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "").alias("lines"))
    return full, narrowed


def extraction_prompts(papers: DataFrame, fields: DataFrame, sectors: DataFrame, subs: DataFrame, contracts: dict[str, str] | None = None) -> DataFrame:
    """papers (field_name, title, text, context_value, instruction) with prompt.

    fields (field_name, description, kind, allowed: none, flat, sectors or sub_sectors, options: list, max_chars). The
    instruction is the field's description where it is null; sub-sectors are narrowed to those of the sector in
    context_value if it is one, else all are shown by sector. Texts are cut to the field's budget, which is the feature.
    """
    said = contracts or CONTRACTS
    full, narrowed = option_blocks(sectors, subs)
    rows = papers.join(fields, "field_name").join(F.broadcast(full)).withColumn("key", F.when(F.col("allowed") == "sub_sectors", sector_key(F.col("context_value"))))
    rows = rows.join(narrowed, "key", "left")
    near = F.concat(F.lit(NARROWED[0]), "context_value", F.lit(NARROWED[1]), "lines")
    options = (
        F.when(F.col("allowed") == "sub_sectors", F.coalesce(near, "grouped")).when(F.col("allowed") == "sectors", F.col("defined"))
        .when(F.col("allowed") == "flat", F.concat(F.lit(FLAT), F.array_join("options", ", "), F.lit("\n"))).otherwise("")
    )
    body = F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.coalesce("max_chars", F.lit(MAX_CHARS)))
    contract = F.when(F.col("kind") == "single_categorical", said["single_categorical"]).otherwise(said["list"])
    paper = F.concat(F.lit(PAPER[0]), F.coalesce("title", F.lit("")), F.lit(PAPER[1]), body, F.lit(PAPER[2]))
    prompt = F.concat(paper, options, F.lit(TASK), F.coalesce("instruction", "description"), F.lit("\n"), contract)
    return rows.select(*papers.columns, prompt.alias("prompt"))


def json_value(value: Column) -> Column:
    """A string as JSON, in the form in which values are shown."""
    quoted = F.to_json(F.array(text.display_fold(value)))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def json_list(values: Column, shown: bool = False) -> Column:
    """A list as JSON; its values as they are if they are in the shown form already."""
    each = lambda x: F.when(x.isNull(), "null").otherwise(F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2))
    return F.concat(F.lit("["), F.array_join(F.transform(values, each), ", "), F.lit("]"))


def shown_lists(rows: DataFrame, *columns: str) -> DataFrame:
    """rows whose list columns hold their values in the shown form; each distinct value that isn't ASCII is folded once."""
    for c in columns:
        values = rows.select(F.explode(c).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn("_s", text.display_fold("_v"))
        lists = rows.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_list", F.col(c)).select("_list", F.posexplode_outer(c).alias("_i", "_v"))
        told = lists.join(values, "_v", "left").groupBy("_list").agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_found"))
        told = told.select("_list", F.filter(F.transform("_found", lambda x: F.when(x["_i"].isNotNull(), F.struct(x["_s"].alias("s")))), lambda x: x.isNotNull()).alias("_found"))
        rows = rows.join(told, F.col(c) == F.col("_list"), "left").withColumn(c, F.transform("_found", lambda x: x["s"])).drop("_list", "_found")
    return rows


def judge_prompt(label: Column, description: Column, predicted_json: Column, truth_json: Column, alternatives: Column | None = None) -> Column:
    """A judge's question. alternatives: of a single true value with several acceptable answers, which are then listed."""
    line = F.concat(F.lit(JUDGED[2]), truth_json)
    if alternatives is not None:
        line = F.when(F.size(alternatives) > 1, F.concat(F.lit(JUDGED[3]), json_list(alternatives))).otherwise(line)
    return F.concat(F.lit(JUDGED[0]), label, F.lit(" ("), description, F.lit(")"), F.lit(JUDGED[1]), predicted_json, F.lit("\n"), line, F.lit(JUDGED[4]))


def case_lists(cases: DataFrame, by: list[str], order: str, most: int = MOST_CASES) -> DataFrame:
    """cases (by, order, is_correct, predicted_json, truth_json, explanation, excerpt) -> per group the failures and successes that a reflector sees.

    Of each kind the first few of a group; tasks keep only these before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*by, "is_correct").orderBy(order))
    failed = F.concat(F.lit("- record "), F.col(order).cast("string"), F.lit(": predicted="), "predicted_json", F.lit(", expected="), "truth_json", F.lit(" ("), F.coalesce("explanation", F.lit("")), F.lit("); excerpt cited: "), json_value(F.col("excerpt")))
    right = F.concat(F.lit("- record "), F.col(order).cast("string"), F.lit(": correctly produced "), "predicted_json", F.lit(" (expected "), "truth_json", F.lit(")"))
    kept = cases.where("is_correct IS NOT NULL").withColumn("_rank", rank).where(F.col("_rank") <= most).withColumn("_line", F.when(F.col("is_correct"), right).otherwise(failed))
    lines = lambda correct: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_correct") == correct, F.struct("_rank", "_line")))), lambda x: x["_line"]), "\n")
    found = kept.groupBy(*by).agg(lines(False).alias("failures"), lines(True).alias("successes"))
    shown = lambda c, none: F.when(F.col(c) == "", none).otherwise(F.col(c)).alias(c)
    return found.select(*by, shown("failures", NO_FAILURES), shown("successes", NO_SUCCESSES))


def avoided(attempts: Column) -> Column:
    """Instructions that were tried in vain, as numbered lines: attempts is a list of struct(instruction, diagnosis)."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x["instruction"], F.lit('" — diagnosis was: '), F.when(F.coalesce(x["diagnosis"], F.lit("")) == "", "(none)").otherwise(x["diagnosis"]))
    return F.array_join(F.transform(attempts, line), "\n")
