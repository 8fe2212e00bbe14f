"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Memtables: what the tasks of a few neighbouring partitions read is aggregated by digest on the map side
and flushed as one run, sorted by digest, of each digest the number of rows and the row that stays. Each
run sets bits of a filter, bitmaps over digest prefixes, one for each bucket of them. Look-up: a digest whose bit
no other run has set is settled. Compaction merges the others of a few runs into one of the next level, which keeps of each digest
the best row, and goes on until one run is left. Verification: only texts whose digest's bit is in the
filter over groups of two or more move, and of each digest the least and the greatest normalised text are
compared byte by byte. Digests that hold different texts are grouped anew by longer digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Partitions whose memtables make up a run, and runs that one compaction merges.
RUN_PARTS, FAN = 8, 8
#: Bits of a filter for each digest that it holds.
BITS_EACH = 16
#: Of Spark's bitmaps: bits in one, as a power of two.
BITMAP = 15


def normalised(text: Column) -> Column:
    """The text (null: empty) without ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    for c in common.WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """(rid, doc_id, points, sha, digest, run) of each row: run numbers the memtables that are flushed together."""
    rows = docs.select(
        "rid",
        F.col("doc_id").cast("long"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"),
        (F.spark_partition_id() / RUN_PARTS).cast("int").alias("run"),
    )
    return common.written(rows.withColumn("digest", F.substring("sha", 1, digest_bytes)), "exact-rows")


def best_first() -> Column:
    """Sorts the row that stays first: most code points, smallest doc_id (null last), first in the table."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")


def flush(rows: DataFrame) -> DataFrame:
    """Level 0: (run, digest, n, best), sorted by run and digest, as the aggregation leaves them."""
    return common.written(rows.groupBy("run", "digest").agg(F.count("*").alias("n"), F.min(best_first()).alias("best")), "exact-run")


def filter_bits(n: int) -> int:
    return max(BITMAP, (BITS_EACH * n - 1).bit_length())


def prefix_bit(digest: Column, bits: int) -> Column:
    """A number of that many bits from the digest's first bytes."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long") % (1 << bits)


def at_bit(rows: DataFrame, bits: int) -> DataFrame:
    """rows with the bucket and place of their digest's bit: a bucket is 2^15 bits."""
    h = prefix_bit(F.col("digest"), bits)
    return rows.withColumn("bucket", F.shiftright(h, BITMAP)).withColumn("place", (h % (1 << BITMAP)).cast("int"))


def bitmaps(places: DataFrame) -> DataFrame:
    """(bucket, bits) of the places, as a table: Spark knows its size, and broadcasts it or deals both sides by bucket."""
    return common.written(places.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")), "exact-filter")


def is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0


def looked_up(level: DataFrame, n: int) -> DataFrame:
    """level, of n digests, with hit: if another run has set the digest's bit."""
    at = at_bit(level, filter_bits(n))
    shared = at.groupBy("bucket", "place").agg(F.min("run").alias("one"), F.max("run").alias("other")).where("one <> other")
    return at.join(bitmaps(shared), "bucket", "left").select(*level.columns, (F.col("bits").isNotNull() & is_set(F.col("bits"), F.col("place"))).alias("hit"))


def compacted(level: DataFrame) -> DataFrame:
    """(digest, n, best) of all runs: level by level, until no two runs may hold the same digest."""
    settled = []
    while True:
        sizes = [r.n for r in level.groupBy("run").agg(F.count("*").alias("n")).collect()]  # a row for each run
        if len(sizes) < 2:
            return reduce(DataFrame.unionByName, [*settled, level.drop("run")])
        found = common.written(looked_up(level, sum(sizes)), "exact-looked-up")
        settled.append(found.where("NOT hit").drop("run", "hit"))
        level = found.where("hit").drop("hit")
        merged = level.groupBy((F.col("run") / FAN).cast("int").alias("run"), "digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        level = common.written(merged, "exact-run")


def may_be_in(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """rows with maybe: if the digest's bit is set in the filter over the groups' digests."""
    bits = filter_bits(n_groups)
    tested = at_bit(rows, bits).join(bitmaps(at_bit(groups.select("digest"), bits)), "bucket", "left")
    return tested.withColumn("maybe", F.col("bits").isNotNull() & is_set(F.col("bits"), F.col("place"))).select(*rows.columns, "maybe")


def clashes(docs: DataFrame, groups: DataFrame, n_groups: int, digest_bytes: int) -> DataFrame:
    """Digests under which texts differ."""
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes))
    hit = may_be_in(texts, groups, n_groups).where("maybe")
    return hit.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest")


def dedup(docs: DataFrame, digest_bytes: int = 32, row: str | None = None) -> DataFrame:
    """Per row of docs the doc_id of the row that stays of its equal texts, their number, and if it stays.

    Texts are equal without ASCII white space; a null text is empty, and empty texts are one group. Of
    rows alike in length and doc_id one stays, the first; a null doc_id comes after all others. Very long
    texts are hashed whole. An empty table gives no rows; other columns of docs are ignored. row names a
    column that numbers the rows, which is returned as rid; digest_bytes below 32 is for tests of clashes.
    """
    docs = docs.select(F.col(row).cast("long").alias("rid") if row else F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    rows = digests(docs, digest_bytes)
    index = common.written(compacted(flush(rows)), "exact-index")
    groups = index.where("n > 1")
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wrong = common.written(clashes(docs, groups, n_groups, digest_bytes), "exact-clashes")
    if not wrong.isEmpty():  # the full digest, verified the same way, tells the texts apart
        if digest_bytes == 32:
            raise ValueError("two different texts have one SHA-256 digest")
        return dedup(docs, 32, "rid")
    told = may_be_in(rows.drop("run", "points"), groups, n_groups)
    of = groups.select("digest", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    alone = told.where("NOT maybe").select("*", *[F.lit(None).cast("long").alias(c) for c in ("n", "keep_id", "keep_rid")])
    placed = alone.unionByName(common.join_hot(told.where("maybe"), of, ["digest"], "n", n_rows, "left"))
    single = F.col("n").isNull()
    return placed.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "rid",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("rid")


SQL = {
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
