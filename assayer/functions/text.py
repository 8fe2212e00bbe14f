"""Text normalisation as column expressions; Arrow UDFs only for Unicode repair and decomposition."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

# Letters that decomposition leaves alone.
LETTERS = {"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "þ": "th", "ı": "i", "İ": "I", "Ø": "O", "Æ": "AE", "Œ": "OE", "Ł": "L", "Đ": "D", "Ð": "D", "Þ": "Th"}
_LETTERS = str.maketrans(LETTERS)

# Wordings of a missing value, by how they match the look-up key.
MISSING_PREFIXES = ["not reported", "not specified", "not specifie", "not applicable", "not stated", "not available", "not mentioned"]
MISSING_EXACT = ["unspecified", "unknown", "none", "n a", "na", "999"]
MISSING = "not reported"


def repaired(text: str) -> str:
    """Undoes UTF-8 that was read as Windows-1252; anything else stays."""
    if text.isascii():
        return text
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text


def unaccented(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def plain(text: str | None) -> str | None:
    if text is None:
        return None
    return re.sub(r"\s+", " ", unaccented(repaired(text)).lower()).strip()


def display(text: str) -> str:
    """As plain, but in its own letters: for values that are shown."""
    return re.sub(r"\s+", " ", unaccented(repaired(text))).strip()


FOLDS = types.StructType([types.StructField("normed", types.StringType()), types.StructField("shown", types.StringType())])


@F.pandas_udf(FOLDS)
def _folds(values: pd.Series) -> pd.DataFrame:
    texts = [None if x is None else repaired(x) for x in values]
    return pd.DataFrame({"normed": [plain(x) for x in texts], "shown": [None if x is None else display(x) for x in texts]}, dtype=object)


@F.pandas_udf(types.StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(plain, na_action="ignore")


@F.pandas_udf(types.ArrayType(types.StringType()))
def _plain_lists(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else [plain(v) for v in x])


@F.pandas_udf(types.StringType())
def _display(values: pd.Series) -> pd.Series:
    return values.map(display, na_action="ignore")


@F.pandas_udf(types.StringType())
def repair_text(values: pd.Series) -> pd.Series:
    return values.map(repaired, na_action="ignore")


#: White space as Python takes it, within ASCII.
SPACES = r"[\s\x1c-\x1f]+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def foreign(value: Column) -> Column:
    """The value if it isn't ASCII, else null: what a UDF has to see."""
    return F.when(~is_ascii(value), value)


def norm_ascii(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), SPACES, " "))


def display_ascii(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACES, " "))


def norm_text(value: Column | str) -> Column:
    """Repaired, without accents, lower case, white space collapsed. ASCII values never reach Python."""
    value = _column(value)
    return F.when(is_ascii(value), norm_ascii(value)).otherwise(_plain(foreign(value)))


def norm_list(values: Column | str) -> Column:
    """A list's values in normed form. Lists of ASCII values never reach Python."""
    values = _column(values)
    plain_ = F.coalesce(is_ascii(F.array_join(values, "")), F.lit(True))
    return F.when(plain_, F.transform(values, norm_ascii)).otherwise(_plain_lists(F.when(~plain_, values)))


def display_fold(value: Column | str) -> Column:
    """Repaired, without accents, white space collapsed; letters and punctuation stay."""
    value = _column(value)
    return F.when(is_ascii(value), display_ascii(value)).otherwise(_display(foreign(value)))


def both_folds(value: Column | str) -> Column:
    """struct(normed, shown) with one repair and one decomposition for each value that isn't ASCII."""
    value = _column(value)
    ascii_ = F.struct(norm_ascii(value).alias("normed"), display_ascii(value).alias("shown"))
    return F.when(is_ascii(value), ascii_).otherwise(_folds(foreign(value)))


def lookup_key(value: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed; diacritics stay."""
    spaced = F.regexp_replace(F.lower(F.trim(value)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def category_fold(normed: Column) -> Column:
    """A normed label without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(normed, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def alternatives(value: Column) -> Column:
    """The values between pipes: trimmed, blanks dropped; none for null."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def value_list(json: Column) -> Column:
    """A JSON value as a list: an array's elements as strings, a scalar's alternatives, nothing for null."""
    variant = F.try_parse_json(json)
    listed = F.try_variant_get(variant, "$", "array<string>")
    scalar = F.try_variant_get(variant, "$", "string")
    return F.when(listed.isNotNull(), F.transform(listed, lambda x: F.coalesce(x, F.lit("None")))).otherwise(alternatives(scalar))


def is_missing(value: Column) -> Column:

    def told(key: Column) -> Column:
        found = key.isin(MISSING_EXACT)
        for prefix in MISSING_PREFIXES:
            found = found | key.startswith(prefix)
        return found

    return F.transform(F.array(lookup_key(value)), told)[0]  # the key is made once


def missing_folded(value: Column) -> Column:
    return F.when(is_missing(value), MISSING).otherwise(value)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stable_id(value: Column) -> Column:
    """An integer as it is, a decimal cut off, else the first 8 hex digits of SHA-256 as a number."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"), F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("bigint"))


def short_model_name(value: Column) -> Column:
    return F.regexp_replace(F.replace(F.element_at(F.split(value, "/"), -1), F.lit("~"), F.lit("")), "-latest$", "")


def stripped_boilerplate(html: Column) -> Column:
    """What follows the first <body ...> tag; the text as it is without one."""
    return F.when(html.rlike("(?i)<body[^>]*>"), F.regexp_replace(html, "(?is)^.*?<body[^>]*>", "")).otherwise(html)


def without_nul(value: Column) -> Column:
    return F.translate(value, "\u0000", "")


def record_markdown(title: Column, abstract: Column, authors: Column, year: Column) -> Column:
    """A record as a small document; only fields that are there have a line. The layout is a fixed value."""
    value = lambda x: F.trim(F.coalesce(x, F.lit("")))
    line = lambda head, x, end: F.when(value(x) != "", F.concat(F.lit(head), value(x), F.lit(end))).otherwise("")
    return F.concat(F.lit("# "), value(title), F.lit("\n\n"), line("**Authors:** ", authors, "  \n"), line("**Year:** ", year.cast("string"), "  \n\n"), line("## Abstract\n\n", abstract, "\n"))


def numbered(criteria: Column) -> Column:
    """A list's items as numbered lines."""
    return F.array_join(F.transform(criteria, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def budgeted(text: Column, limit: int = 10_000) -> Column:
    return F.substring(text, 1, limit)
