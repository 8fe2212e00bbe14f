"""The nearest of many options by similarity: a walk down a tree of the options' beginnings, with bounds.

With L the longest common subsequence, texts of n and m characters have the ratio 200 L / (n + m). Options that begin
alike share a node, where L of that beginning is known for every beginning of the value, in a bit for each character.
What is left of both texts bounds L from there, so a value goes on only where an option may be nearer than its guess.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from .tables import durable

#: Stretches of so many characters, and words, are looked up for a first guess: the rarest of each kind. They set how far values walk, not what is found.
GRAMS = (4, 8)
#: Edges of a level that are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_EDGES = 100_000
NODE = ["h", "g"]
STEP = "value string, rank long, score double, s string, near long, total long, guess long, k int, free binary, h long, g long"


def named(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def mask(text: Column) -> Column:
    """A bit for each character that occurs, those 64 code points apart together."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda x, c: x.bitwiseOR(bit(c)))


def edges(options: DataFrame) -> DataFrame:
    """options (rank, t) as a tree: (level, h, g, k, label, to_h, to_g, low, high, least, rank, mask).

    A node is a beginning after which options differ, and the empty one; it has a row for each way on, with the
    characters up to the next node, or with the option's rank to its end. low to high are the lengths, least the
    least rank, and mask the characters of the options there.
    """
    o = options.withColumns({"m": F.length("t"), "mask": mask(F.col("t"))})
    at = o.select("rank", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("k"), "t").withColumn("start", F.substring("t", F.lit(1), F.col("k")))
    at = at.select("rank", "k", *named(F.col("start")), F.substring("t", F.col("k") + 1, F.lit(1)).alias("next"))
    forks = at.groupBy(*NODE).agg(F.min("next").alias("one"), F.max("next").alias("other")).where("one <> other").select(*NODE)
    met = at.join(forks, NODE, "left_semi").groupBy("rank").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    ks = F.array_sort(F.array_union(F.array(F.lit(0)), F.coalesce("ks", F.array().cast("array<int>"))))
    each = o.join(met, "rank", "left").withColumn("ks", ks).select("*", F.posexplode("ks").alias("level", "k"))
    end = F.get("ks", F.col("level") + 1)
    each = each.withColumns({"end": end, "label": F.substring("t", F.col("k") + 1, F.coalesce(end, F.col("m")) - F.col("k"))})
    begin, onward = F.substring("t", F.lit(1), F.col("k")), F.substring("t", F.lit(1), F.col("end"))
    each = each.select("level", *named(begin), "k", "label", F.when(end.isNotNull(), F.xxhash64(onward)).alias("to_h"), F.when(end.isNotNull(), F.xxhash64(F.lit(1), onward)).alias("to_g"), "m", "rank", "mask")
    ways = each.groupBy("level", *NODE, "k", "label", "to_h", "to_g")
    ways = ways.agg(F.min("m").alias("low"), F.max("m").alias("high"), F.min("rank").alias("least"), F.bit_or("mask").alias("mask"))
    return ways.withColumn("rank", F.when(F.col("to_h").isNull(), F.col("least")))


@lru_cache(maxsize=1024)
def places(s: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    return where


def beats(near: int, total: int, guess: int, found: int, length: int, rank: int) -> bool:
    """If a common subsequence of found of length characters in all is nearer than the guess, or as near and of less rank."""
    if not length:
        found, length = 1, 2
    more = found * total - near * length
    return more > 0 or (more == 0 and rank < guess)


def may_beat(s: str, free: int, k: int, low: int, high: int, mask: int, near: int, total: int, guess: int, least: int) -> bool:
    """If an option of low to high characters, whose first k left these bits, can beat the guess."""
    left, common = sum(mask >> (ord(c) % 64) & 1 for c in s), 0
    for i in range(len(s) + 1):
        rest = min(max(left, low - k), high - k)
        if beats(near, total, guess, common + min(left, rest), len(s) + k + rest, least):
            return True
        if i < len(s):
            left -= mask >> (ord(s[i]) % 64) & 1
            common += not free >> i & 1
    return False


def step(met: DataFrame) -> DataFrame:
    """Live rows met with the ways on from their nodes: options that beat the guess, with their score, and rows that go on."""
    schema = pa.schema([("value", pa.string()), ("rank", pa.int64()), ("score", pa.float64()), ("s", pa.string()), ("near", pa.int64()), ("total", pa.int64()), ("guess", pa.int64()), ("k", pa.int32()), ("free", pa.binary()), ("h", pa.int64()), ("g", pa.int64())])
    columns = ("value", "s", "near", "total", "guess", "k", "free", "label", "to_h", "to_g", "low", "high", "least", "rank", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, s, near, total, guess, k, bits, label, h, g, low, high, least, rank, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, all_ = places(s), (1 << len(s)) - 1
                free = int.from_bytes(bits, "little") & all_
                for c in label:
                    hit = free & where.get(c, 0)
                    free = ((free + hit) | (free - hit)) & all_
                k += len(label)
                if rank is not None:
                    common, length = len(s) - free.bit_count(), len(s) + k
                    if beats(near, total, guess, common, length, rank):
                        rows.append((value, rank, 200.0 * common / length if length else 100.0, *[None] * 8))
                elif may_beat(s, free, k, low, high, chars, near, total, guess, least):
                    rows.append((value, None, None, s, near, total, guess, k, free.to_bytes(len(bits), "little"), h, g))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return met.select(*columns).mapInArrow(run, STEP)


def guesses(values: DataFrame, options: DataFrame) -> DataFrame:
    """Per value (value, s) an option (rank, t) that is likely near: by its rarest stretch or word that options hold, or the first one."""

    def parts(text: Column) -> Column:
        none = F.array().cast("array<string>")
        of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)
        kinds = [*[of(n) for n in GRAMS], F.split(text, " ")]
        ready = lambda k: F.transform(F.array_distinct(kinds[k]), lambda x: F.struct(F.lit(k).alias("kind"), F.xxhash64(x).alias("part")))
        return F.flatten(F.array(*[ready(k) for k in range(len(kinds))]))

    known = options.select("rank", F.inline(parts(F.col("t")))).groupBy("kind", "part").agg(F.count("*").alias("times"), F.min("rank").alias("rank"))
    met = values.select("value", F.inline(parts(F.col("s")))).join(known, ["kind", "part"])
    rare = met.groupBy("value", "kind").agg(F.min(F.struct("times", "rank")).alias("m")).select("value", "m.rank")
    first = options.agg(F.min("rank").alias("rank")).where("rank IS NOT NULL")  # one row
    asked = rare.unionByName(values.select("value").join(F.broadcast(first))).distinct()
    told = asked.join(values, "value").join(options, "rank").withColumn("score", fuzzy.plain_ratio("s", "t"))
    best = F.max_by(F.struct("s", "rank", "score", F.length("t").alias("m")), F.struct("score", -F.col("rank")))
    return told.groupBy("value").agg(best.alias("b")).select("value", "b.*")


def nearest(values: DataFrame, options: DataFrame) -> DataFrame:
    """values (value, text), options (rank, text), both distinct: per value the rank of its most similar option, and the ratio.

    Of options equally near the one with the least rank. Values near to some option meet few nodes beside that
    option's own; a value that is near to none may have to walk all over the tree, which no order of options avoids.
    """
    tree = durable(edges(options.select(F.col("rank").cast("long").alias("rank"), F.col("text").alias("t"))))
    levels = {r.level: r["count"] for r in tree.groupBy("level").count().collect()}  # as many rows as options have forks one after the other
    wide = values.sparkSession.sparkContext.defaultParallelism
    guess = durable(guesses(values.select("value", F.col("text").alias("s")), options.select(F.col("rank").cast("long").alias("rank"), F.col("text").alias("t"))))
    n = F.length("s")
    total = n + F.col("m")
    near = F.when(total > 0, F.round(F.col("score") * total / 200)).otherwise(1).cast("long")
    bits = F.unhex(F.repeat(F.lit("FF"), F.ceil(n / 8).cast("int")))
    live = guess.select("value", "s", near.alias("near"), F.when(total > 0, total).otherwise(2).cast("long").alias("total"), F.col("rank").alias("guess"), bits.alias("free"), *named(F.lit("")))
    live, found = live.repartition(wide), [guess.select("value", "rank", "score")]
    for level in range(max(levels, default=-1) + 1):
        ways = tree.where(F.col("level") == level).drop("level")
        told = durable(step(live.drop("k").join(F.broadcast(ways) if levels[level] <= BROADCAST_EDGES else ways, NODE)))
        found.append(told.where("rank IS NOT NULL").select("value", "rank", "score"))
        live = told.where("rank IS NULL").drop("rank", "score")
        if live.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("value").agg(F.max_by(F.struct("rank", "score"), F.struct("score", -F.col("rank"))).alias("best")).select("value", "best.*")
