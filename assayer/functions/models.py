"""What a model's name tells: its size for a rough footprint, and which judge is of another family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: billions of active and of all parameters by the first part that a name contains
PARAMETERS = [
    ("gpt-mini", 8.0, 8.0),
    ("gpt-latest", 100.0, 440.0),
    ("claude-haiku", 8.0, 8.0),
    ("claude-sonnet", 70.0, 70.0),
    ("claude-opus", 300.0, 300.0),
    ("gemini-flash", 8.0, 32.0),
    ("gemini-pro", 100.0, 440.0),
    ("deepseek-v4-flash", 3.0, 30.0),
    ("deepseek-v4-pro", 37.0, 671.0),
    ("deepseek", 37.0, 671.0),
    ("qwen3-30b-a3b", 3.0, 30.0),
    ("qwen3-235b-a22b", 22.0, 235.0),
    ("llama-4-scout", 17.0, 109.0),
    ("llama-4-maverick", 17.0, 400.0),
    ("llama-3.3-70b", 70.0, 70.0),
    ("mistral-small", 24.0, 24.0),
    ("mistral-medium", 40.0, 40.0),
    ("glm-4.7-flash", 9.0, 9.0),
    ("glm-5", 32.0, 355.0),
    ("glm", 32.0, 355.0),
    ("kimi", 32.0, 1000.0),
]
UNKNOWN = (8.0, 70.0)


def parameters(model: Column) -> Column:
    """(active, total) in billions; of a name that contains none of the parts the fallback, of a null name too."""
    pair = lambda active, total: F.struct(F.lit(active).alias("active"), F.lit(total).alias("total"))
    found = pair(*UNKNOWN)
    for part, active, total in reversed(PARAMETERS):
        found = F.when(F.lower(model).contains(part), pair(active, total)).otherwise(found)
    return found


def judge_of_other_family(model: Column, marks: list[str], judge: str, other: str) -> Column:
    """other for the models whose name holds one of marks (judge's own family), judge for all others."""
    own = F.lit(False)
    for mark in marks:
        own = own | F.coalesce(F.lower(model).contains(mark), F.lit(False))
    return F.when(own, other).otherwise(judge)
