"""Source divergence audit: chi-square distances between the sources of a language, in exact whole numbers.

A source has no row for a term that it lacks, so the sum over all terms is taken apart by supports, and put
together by inclusion and exclusion. Both without the term: a constant times the number of terms. One with it:
its histogram of shares prices the term against the other's share of a missing one. Both with it: a join of
the two postings corrects what the one-sided prices counted. Nothing is as large as sources times terms.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that a kept term is in at least; what shares are multiplied by; ranks of terms.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Runs of letters and of all beyond ASCII, in UTF-8 after A-Z were lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms of all groups that a task adds up before it hands them on.
HELD_TERMS = 200_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents, added up in each task as far as memory is bounded."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        def handed_on():
            for (lang, source), (count, of) in held.items():
                terms = list(count)
                yield common.batch_of(
                    schema, [lang] * len(terms), [source] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), list(count.values()), [of[t] for t in terms]
                )

        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(common.texts_of(batch, c) for c in ("lang", "source", "text")), strict=True):
                words = TERM.findall(text.encode().lower())  # bytes.lower() changes A-Z only
                count, of = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(words)
                of.update(set(words))
            if sum(len(count) for count, _ in held.values()) > HELD_TERMS:
                yield from handed_on()
                held = {}
        yield from handed_on()

    return common.mapped(docs, run, "lang string, source string, term string, count long, docs long")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); null without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {UNIT}BD) div ({total} + {terms}) END")


def price(p: str, q: str) -> str:
    """floor((p - q)^2 / q): shares are at most UNIT + 1, so a long holds the square."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, postings): the kept terms with their sources and counts there, a language's sources at most."""
    postings = counted(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = postings.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("postings"))
    return common.written(terms.where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")


def grouped(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(gid, lang, source, terms, total, lang_total, p0): every occurring group, p0 its share of a missing term."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    totals = terms.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("count").alias("total"))
    found = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    found = found.na.fill(0, ["terms", "total", "lang_total"]).withColumn("p0", share("0", "total", "terms"))
    return common.written(found.withColumn("gid", F.monotonically_increasing_id()), "divergence-groups")


def shares(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, gid, p, p0, q): of each group's terms its share and the language's."""
    at = terms.select("lang", "term", F.col("total").alias("lang_count"), F.inline("postings")).join(groups, ["lang", "source"])
    return common.written(at.select("lang", "term", "gid", share("count", "total", "terms").alias("p"), "p0", share("lang_count", "lang_total", "terms").alias("q")), "divergence-shares")


def pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, t, value): the price of s against t over all kept terms."""
    side = lambda x: groups.select("lang", F.col("gid").alias(x), F.col("p0").alias(f"{x}0"), "terms")
    both_zero = side("s").join(side("t").drop("terms"), "lang").where("s <> t")
    both_zero = both_zero.select("s", "t", F.expr(f"CASE WHEN terms > 0 THEN terms * {price('s0', 't0')} ELSE 0L END").alias("value"))
    # one-sided: a share that so many terms have in one group, against every other group of the language
    histogram = held.groupBy("lang", F.col("gid").alias("s"), F.col("p0").alias("s0"), "p").agg(F.count("*").alias("n"))
    priced = histogram.join(side("t").drop("terms"), "lang").where("s <> t").groupBy("s", "t").agg(
        F.sum(F.expr(f"n * ({price('p', 't0')} - {price('s0', 't0')})")).alias("there"),
        F.sum(F.expr(f"n * ({price('t0', 'p')} - {price('t0', 's0')})")).alias("back"),
    )
    # overlap: terms that both have, where the one-sided prices counted either side as if the other lacked it
    posting = lambda x: held.select("lang", "term", F.col("gid").alias(x), F.col("p").alias(f"{x}p"), F.col("p0").alias(f"{x}0"))
    exact = lambda x, y: F.sum(F.expr(f"{price(f'{x}p', f'{y}p')} - {price(f'{x}p', f'{y}0')} - {price(f'{x}0', f'{y}p')} + {price(f'{x}0', f'{y}0')}"))
    corrected = posting("s").join(posting("t"), ["lang", "term"]).where("s < t").groupBy("s", "t").agg(exact("s", "t").alias("there"), exact("t", "s").alias("back"))
    for part in (priced, corrected):
        both_zero = both_zero.unionByName(part.select("s", "t", F.col("there").alias("value"))).unionByName(part.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("back").alias("value")))
    return both_zero.groupBy("s", "t").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per (lang, source): the other sources of the language by distance, and the terms it has most in excess of the language.

    Null text, lang and source are ''; a row is a document, also where doc_ids repeat. Groups without a kept
    term have the shares of one that lacks all; without kept terms in the language distances are 0. Equal
    values are ranked by item in UTF-8 order. Very long texts are read whole, their terms whatever their
    length. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = kept_terms(docs, least_docs)
    groups = grouped(docs, terms)
    held = shares(terms, groups)
    named = groups.select(F.col("gid").alias("s"), "lang", "source")
    pairs = pair_values(held, groups).join(named, "s").join(groups.select(F.col("gid").alias("t"), F.col("source").alias("item")), "t")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("*", ranked)
    excess = held.where("p > q").select("gid", F.col("term").alias("item"), F.expr(price("p", "q")).alias("value"))
    best = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item")).alias("rank")  # tasks keep their own best before the shuffle
    best = excess.select("*", best).where(F.col("rank") <= top).join(named.withColumnRenamed("s", "gid"), "gid")
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


SQL = {
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_count) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS count FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(count), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.count, 0) AS count,
         1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.count, 0) + 1) // CAST(gn.n + l.v AS HUGEINT) AS p,
         1 + CAST({UNIT} AS HUGEINT) * (k.lang_count + 1) // CAST(l.n + l.v AS HUGEINT) AS q
  FROM gn JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source AS one, t.source AS two, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value FROM dense s JOIN dense t ON s.lang = t.lang AND s.term = t.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.one = a.source AND x.two = b.source
  GROUP BY a.lang, a.source, b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM dense WHERE count > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}"""
}
