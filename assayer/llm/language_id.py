"""Language ID by Bayesian evidence fusion.

Hypotheses are all declared languages, however many, and `und`, no language. Text likelihoods come from letter trigrams,
counted over all rows by declared language; und spreads evenly over all trigrams. Three more kinds of
evidence join them: the declared language, with the reliability that the table itself shows; the address
suffix; and the host, whose prior is smoothed towards its suffix's, that one towards all rows'. Counts
leave out the row that they judge. All counts are grouped aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Trigram buckets; how far trigrams that overlap count as independent.
BUCKETS, TEMPER = 4096, 0.25
#: Languages that are counted or scored together: bounds the memory, leaves none out.
LANGUAGES_AT_ONCE = 64
#: Weight, in rows, of the suffix's prior for a host and of the overall prior for a suffix; prior of und.
SMOOTHING, UND_PRIOR = 20.0, 1e-9
#: Characters looked at together.
CHUNK = 1 << 19
UND = "und"

_FOLD: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Code point -> a number for its lower-case letter, 0 for what isn't a letter."""
    if not _FOLD:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        found = np.zeros(0x110000, np.uint32)
        letters = np.array([ord(c) for c in regex.findall(r"\p{L}", every)])
        found[letters] = [ord(chr(c).lower()[0]) for c in letters]
        _FOLD.append(found)
    return _FOLD[0]


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts the buckets of their letter trigrams, and for each its text's number."""
    group, size = [], 0
    for i, text in [*enumerate(texts), (len(texts), "")]:
        if group and (size + len(text) > CHUNK or i == len(texts)):
            # blanks around each text: a trigram belongs to the text of its middle letter
            cp = folded()[np.frombuffer(("\0" + "".join(x + "\0\0" for _, x in group)).encode("utf-32-le", "surrogatepass"), np.uint32)]
            row = np.append(0, np.repeat([k for k, _ in group], [len(x) + 2 for _, x in group]))
            a, b, c = cp[:-2], cp[1:-1], cp[2:]
            keep = (b != 0) & ((a != 0) | (c != 0))
            mixed = (a[keep] * np.uint32(0x9E3779B1)) ^ (b[keep] * np.uint32(0x85EBCA6B)) ^ (c[keep] * np.uint32(0xC2B2AE35))
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(20)).astype(np.int64), row[1:-1][keep]
            group, size = [], 0
        group.append((i, text))
        size += len(text)


def trigram_counts(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all rows by declared language, of those that are there: language * BUCKETS + bucket, and how many."""
    number, schema = {x: i for i, x in enumerate(languages)}, pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def cells(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = [(k * BUCKETS + np.flatnonzero(x), x[x > 0]) for k, x in total.items()]
        return common.batch_of(schema, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            declared = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for bucket, row in trigrams(common.texts_of(batch)):
                which, at = np.unique(declared[row], return_inverse=True)
                for first in range(0, len(which), LANGUAGES_AT_ONCE):
                    part = which[first : first + LANGUAGES_AT_ONCE]
                    here = (at >= first) & (at < first + len(part))
                    counted = np.bincount((at[here] - first) * BUCKETS + bucket[here], minlength=len(part) * BUCKETS).reshape(-1, BUCKETS)
                    for k, n in zip(part.tolist(), counted, strict=True):
                        total[k] = total[k] + n if k in total else n.copy()
                    if len(total) > LANGUAGES_AT_ONCE:
                        yield cells(total)
                        total = {}
        if total:
            yield cells(total)

    summed = common.mapped(rows.select("declared", "text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    cell, n = (summed.column(k).to_numpy() for k in range(2))
    order = np.argsort(cell)
    return cell[order], n[order]


def text_evidence(rows: DataFrame, cell: np.ndarray, n: np.ndarray, n_languages: int) -> DataFrame:
    """Adds evidence: for each hypothesis the tempered log-likelihood of the text; letters: if it has any."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("letters", pa.bool_()), ("evidence", pa.list_(pa.float64()))])
    all_ = np.log(np.bincount(cell // BUCKETS, n, n_languages) + 0.5 * BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = np.zeros((batch.num_rows, n_languages + 1)), np.zeros(batch.num_rows)
            groups = list(trigrams(common.texts_of(batch)))
            for first in range(0, n_languages, LANGUAGES_AT_ONCE):
                last = min(first + LANGUAGES_AT_ONCE, n_languages)
                a, b = np.searchsorted(cell, [first * BUCKETS, last * BUCKETS])
                log_p = np.full((last - first) * BUCKETS, np.log(0.5))
                log_p[cell[a:b] - first * BUCKETS] = np.log(n[a:b] + 0.5)
                log_p = log_p.reshape(-1, BUCKETS) - all_[first:last, None]
                for bucket, row in groups:
                    for k, table in enumerate(log_p, first):
                        total[:, k] += np.bincount(row, table[bucket], minlength=batch.num_rows)
            for _, row in groups:
                size += np.bincount(row, minlength=batch.num_rows)
            total[:, -1] = size * np.log(1 / BUCKETS)
            yield common.batch_of(schema, *(batch.column(i) for i in range(5)), size > 0, list(TEMPER * total))

    text = rows.select("rid", "doc_id", "declared", "host", "suffix", "text")
    return common.mapped(text, run, "rid long, doc_id long, declared string, host string, suffix string, letters boolean, evidence array<double>")


def tally(seen: DataFrame, by: str) -> DataFrame:
    """Per value of by how many rows have each text language: a map from its number, without the zeros."""
    counts = seen.where(F.col(by).isNotNull()).groupBy(by, "k").agg(F.count("*").alias("n"))
    return common.written(counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(f"by_{by}"), F.sum("n").alias(f"n_{by}")), f"language-{by}")


def constants(values) -> Column:
    return F.array(*map(F.lit, values))


def identify(docs: DataFrame, text: Column, declared: Column, host: Column, suffix: Column, threshold: float = 0.5) -> DataFrame:
    """Per row of docs lang, probability, text_lang (by the text alone) and rejected.

    Rejected are rows without letters (null and empty texts among them), those that fit no language, and
    those whose best language is less likely than threshold. A null declared language, host or suffix is
    no evidence. Without any declared language in the table every row is und. doc_id may be null or
    repeat; rid numbers the rows. An empty table gives no rows; other columns of docs are ignored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), text.alias("text"),
        F.lower(declared).alias("declared"), host.alias("host"), suffix.alias("suffix"),
    )
    known = rows.where("declared IS NOT NULL").select("declared").distinct()
    languages = sorted(r.declared for r in known.collect())
    none = np.zeros(0, np.int64)
    cell, n = trigram_counts(rows.where("declared IS NOT NULL"), languages) if languages else (none, none)
    names, und = [*languages, UND], len(languages)
    seen = common.written(text_evidence(rows, cell, n, und), "language-text")

    every = F.col("evidence")
    by_text = F.when(F.col("letters"), F.array_position(every, F.array_max(every)).cast("int") - 1).otherwise(und)
    seen = seen.withColumn("k", by_text)
    overall, agreed = np.zeros(und + 1), np.zeros(und + 1)
    for k, count, said in seen.groupBy("k").agg(F.count("*"), F.count("declared")).collect():  # a row for each language
        overall[k], agreed[k] = count, said
    prior = (overall[:-1] + 1) / (overall[:-1].sum() + max(1, und))
    prior = np.append(prior * (1 - UND_PRIOR), UND_PRIOR)

    joined = seen
    for by in ("host", "suffix"):
        joined = joined.join(tally(seen, by), by, "left")
    joined = joined.join(F.broadcast(tally(seen, "declared")), "declared", "left")  # a row for each language
    count = lambda by, i: F.coalesce(F.try_element_at(f"by_{by}", i), F.lit(0))

    def post(evidence: Column, i: Column) -> Column:
        level = F.get(constants(prior.tolist()), i)
        own = F.when(F.col("k") == i, 1.0).otherwise(0.0)
        for by in ("suffix", "host"):
            smooth = (count(by, i) - own + SMOOTHING * level) / (F.col(f"n_{by}") - 1 + SMOOTHING)
            level = F.coalesce(smooth, level)
        # P(declared | language), from the rows themselves; und declares each alike
        spoken = F.when(i == und, F.lit(float(-np.log(max(1, und))))).otherwise(F.log((count("declared", i) + 1.0) / F.get(constants((agreed + und).tolist()), i)))
        return evidence + F.log(level) + F.when(F.col("declared").isNotNull(), spoken).otherwise(0.0)

    fused = joined.withColumn("post", F.transform(every, post)).withColumn("top", F.array_max("post"))
    fused = fused.withColumn("probability", 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    label = constants(names)
    best = F.when(F.col("letters"), label[F.array_position("post", F.col("top")).cast("int") - 1]).otherwise(UND)
    out = fused.withColumn("lang", best).withColumn("text_lang", label[F.col("k")])
    rejected = (F.col("lang") == UND) | (F.col("probability") < threshold)
    return out.select("rid", "doc_id", "lang", "probability", "text_lang", "declared", rejected.alias("rejected"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """documents: lang is the declared language, source the host; there is no address, so no suffix."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """pages: the language that <html lang> declares, host and suffix of the address, the text without tags."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    lang = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)
    host = F.expr("try_parse_url(url, 'HOST')")
    return identify(pages.withColumn("doc_id", F.col("page_id")), text, F.nullif(lang, F.lit("")), host, F.element_at(F.split(host, r"\."), -1)).withColumnRenamed("doc_id", "page_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(common.table(spark, sf_dir, "documents")).drop("rid")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(common.table(spark, sf_dir, "pages")).drop("rid")


MORE_QUERIES = {"language_id_pages": language_id_pages}
