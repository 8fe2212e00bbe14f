"""Worked examples inside a prompt's text: parsed, checked, merged and written back, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the format of a prompt with examples
SENTINEL = "---FEW-SHOT EXAMPLES---"
SEPARATOR = "---"
MOST = 6
PAPER_CHARS = 200


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def example(paper: Column, answer: Column) -> Column:
    return F.struct(paper.alias("paper"), answer.alias("answer"))


def base(prompt: Column) -> Column:
    """The instruction before the examples; the whole prompt where there are none."""
    at = F.instr(prompt, SENTINEL)
    return F.when(at > 0, F.regexp_replace(F.substring(prompt, F.lit(1), at - 1), r"\s+$", "")).otherwise(prompt)


def parse(prompt: Column) -> Column:
    """The examples that have both a paper and an answer; an empty array where there are none."""
    line = lambda part, name: F.regexp_extract(part, rf"(?m)^{name}:\s*(.+)$", 1)
    block = F.when(F.instr(prompt, SENTINEL) > 0, F.substring(prompt, F.instr(prompt, SENTINEL) + len(SENTINEL), F.length(prompt))).otherwise("")
    parts = F.split(block, rf"(?m)^{SEPARATOR}\s*$")
    unquoted = lambda text: stripped(F.regexp_replace(stripped(text), r'^"+|"+$', ""))
    found = F.transform(parts, lambda part: example(line(part, "Paper"), line(part, "Answer")))
    there = F.filter(found, lambda x: (x["paper"] != "") & (x["answer"] != ""))
    return F.transform(there, lambda x: example(unquoted(x["paper"]), stripped(x["answer"])))


def serialise(instruction: Column, examples: Column) -> Column:
    """The inverse of parse: the instruction as it is where there are no examples."""
    lines = F.transform(examples, lambda x: F.concat(F.lit('Paper: "'), x["paper"], F.lit('"\nAnswer: '), x["answer"]))
    text = F.concat(F.regexp_replace(instruction, r"\s+$", ""), F.lit(f"\n\n{SENTINEL}\n"), F.array_join(lines, f"\n{SEPARATOR}\n"))
    return F.when(F.size(examples) > 0, text).otherwise(instruction)


def merge(kept: Column, proposed: Column, most: int = MOST) -> Column:
    """Both lists in order, each pair once whatever its case or outer blanks, the first `most` of them."""
    key = lambda x: F.concat_ws("|", F.lower(stripped(x["paper"])), F.lower(stripped(x["answer"])))
    keyed = F.transform(F.concat(kept, proposed), lambda x: F.struct(key(x).alias("key"), x.alias("example")))  # each key once
    none = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<struct<paper:string,answer:string>>").alias("examples"))

    def add(found: Column, x: Column) -> Column:
        more = F.struct(F.concat(found["keys"], F.array(x["key"])).alias("keys"), F.concat(found["examples"], F.array(x["example"])).alias("examples"))
        return F.when((F.size(found["keys"]) < most) & ~F.array_contains(found["keys"], x["key"]), more).otherwise(found)

    return F.aggregate(keyed, none, add, lambda found: found["examples"])


def legal(examples: Column, answers: Column) -> Column:
    """Examples on one line each, papers cut, blank ones and answers outside the allowed (lower-case) ones dropped; null answers allow all."""
    flat = lambda text: F.replace(stripped(text), F.lit("\n"), F.lit(" "))
    cut = F.transform(examples, lambda x: example(F.substring(flat(x["paper"]), 1, PAPER_CHARS), flat(x["answer"])))
    allowed = lambda x: answers.isNull() | F.array_contains(answers, F.lower(x["answer"]))
    return F.filter(cut, lambda x: (x["paper"] != "") & (x["answer"] != "") & allowed(x))


def joined(examples: Column) -> Column:
    return F.array_join(F.transform(examples, lambda x: F.concat_ws("|", x["paper"], x["answer"])), ";")
