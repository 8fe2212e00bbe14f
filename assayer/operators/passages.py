"""Texts that share words in a row: an equi-join on hashes of word shingles, both sides dealt by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .tables import durable, spread

#: A quotation: so many words in a row of a passage, or the whole passage if it has fewer.
QUOTED_WORDS = 8
ROW = ["_r1", "_r2"]
#: Shingles of the smaller table that are broadcast, about 50 bytes each; more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def raw_words(value: Column) -> Column:
    """Words between ASCII white space, as they are."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def folded_words(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.norm_text(value), F.lit("")), " "), lambda x: x != "")


def shingles(words: Column, n: Column) -> Column:
    """The stretches of n words, each as 128 bits; none if there are fewer words."""
    of = lambda i: F.slice(words, i, n)
    at = F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.xxhash64(of(i)).alias("h"), F.xxhash64(F.lit(1), of(i)).alias("g")))


def sharing(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], n: int, whole_left: bool = True) -> DataFrame:
    """Distinct (left_keys, right_keys) of rows whose `words` share n in a row, or all words of the one that has fewer.

    right is the smaller table: its rows give shingles of every length up to n, left only of n, of its own
    length if that is less, and of the lengths of right's shorter rows. Without whole_left, left's shorter rows
    only share what is a whole row of right.
    """
    full = F.least(F.size("words"), F.lit(n))
    short = right.where(F.size("words").between(1, n - 1)).select(F.size("words").alias("n"))
    lengths = short.agg(F.coalesce(F.array_sort(F.collect_set("n")), F.array().cast("array<int>")).alias("lengths"))  # one row
    of_left = F.filter("lengths", lambda k: k < full)
    own = F.when((F.size("words") >= n) | F.lit(whole_left), F.array(full)).otherwise(F.filter(F.array(full), lambda k: F.array_contains("lengths", k)))
    one = left.join(F.broadcast(lengths)).withColumn("n", F.explode(F.concat(own, of_left)))
    other = right.withColumn("n", F.explode(F.when(full > 0, F.sequence(F.lit(1), full)).otherwise(F.array().cast("array<int>"))))
    # a shingle of right that is shorter than n counts if it is all of right's words, or all of left's
    of_one = one.select(*left_keys, (F.size("words") == F.col("n")).alias("_all_left"), "n", F.inline(shingles(F.col("words"), F.col("n"))))
    of_other = other.select(*right_keys, (F.size("words") == F.col("n")).alias("_all_right"), "n", F.inline(shingles(F.col("words"), F.col("n"))))
    counts = (F.col("n") == n) | F.col("_all_right") | (F.col("_all_left") if whole_left else F.lit(False))
    of_other = durable(of_other)
    few = of_other.count() <= BROADCAST_SHINGLES  # then left's shingles, a row for each word, needn't move
    return of_one.join(F.broadcast(of_other) if few else of_other, ["n", "h", "g"]).where(counts).select(*left_keys, *right_keys).distinct()


def named(rows: DataFrame, id_: str, as_: list[str]) -> DataFrame:
    """rows with two columns that name them by id and text: they are the same whenever the table is read."""
    return rows.withColumn(as_[0], F.xxhash64(id_, "text")).withColumn(as_[1], F.xxhash64(F.lit(1), id_, "text"))


def excerpt_pairs(documents: DataFrame, passages: DataFrame, words: int = 3) -> DataFrame:
    """documents (doc_id, text), passages (item_id, text): (doc_id, item_id, excerpt, source) that share words in a row.

    Words are normalised; shared are so many in a row, or all words of the shorter text if it has fewer. Blank
    texts share nothing. Texts move once, to the pairs that were found.
    """
    docs = named(documents.select("doc_id", "text"), "doc_id", ["_r1", "_r2"])
    items = named(passages.select("item_id", "text"), "item_id", ["_i1", "_i2"])
    ready = lambda rows, keys: rows.select(*keys, folded_words(F.col("text")).alias("words"))
    found = durable(sharing(ready(docs, ROW), ready(items, ["_i1", "_i2"]), ROW, ["_i1", "_i2"], words))  # its size tells if texts have to be dealt
    met = docs.withColumnRenamed("text", "source").join(found, ROW).join(items.withColumnRenamed("text", "excerpt"), ["_i1", "_i2"])
    return spread(met.select("doc_id", "item_id", "excerpt", "source"))


def leaked(documents: DataFrame, passages: DataFrame, words: int = QUOTED_WORDS) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that quote a passage: so many words in a row, wherever they stand in it, or all of it."""
    docs = documents.select("doc_id", raw_words(F.col("text")).alias("words"))
    items = passages.select("item_id", raw_words(F.col("text")).alias("words"))
    return sharing(docs, items, ["doc_id"], ["item_id"], words, whole_left=False)


def with_truth(rows: DataFrame, truth: DataFrame, key: str = "record_id") -> DataFrame:
    """rows marked `leak` if their key has a truth anywhere: a semi-join on ids, that of rows without a key finds nothing."""
    ids = truth.select(key).distinct().withColumn("leak", F.lit(True))
    return rows.join(ids, key, "left").withColumn("leak", F.coalesce("leak", F.lit(False)))
