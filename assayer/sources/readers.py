"""Readers of the files that evaluations come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import ranks


def markdown_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, text) of a folder's *.md files whose stem is a number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select(stem.try_cast("long").alias("record_id"), F.col("content").cast("string").alias("text")).where("record_id IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSONL whose records end at \\n alone: other Unicode line ends stay inside a record."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text; a byte order mark before the first name is dropped."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return found.toDF(*[c.lstrip("﻿").strip() for c in found.columns])


SCREENING, EXTRACTION = {"record_id", "decision"}, {"record_id", "field_name", "value"}


def upload_kind(columns: list[str]) -> str:
    """Which upload a header belongs to; an error that names what is missing."""
    have = set(columns)
    if have >= EXTRACTION:
        return "extraction"
    if have >= SCREENING:
        return "screening"
    raise ValueError(f"columns missing: {sorted((EXTRACTION if 'field_name' in have else SCREENING) - have)}")


def first_of(df: DataFrame, *names: str) -> Column:
    """The first column there is among names, whatever its case; null if none."""
    by_name = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{by_name[n]}`") for n in names if n in by_name]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def screening_records(df: DataFrame) -> DataFrame:
    """An export of references with varying headers; rows without title and abstract are left out."""
    out = df.select(
        first_of(df, "u1", "record_id", "id").alias("raw_id"),
        first_of(df, "t1", "title").alias("title"),
        first_of(df, "ab", "abstract").alias("abstract"),
        first_of(df, "a1", "author", "authors").alias("author"),
        first_of(df, "py", "year").alias("year"),
        first_of(df, "ta_decision", "decision").alias("decision"),
    )
    return out.where("coalesce(trim(title), '') <> '' OR coalesce(trim(abstract), '') <> ''")


def decision_object(cell: Column) -> Column:
    """A cell's decision as JSON: include, exclude with its tag, or maybe with what it says; null for an empty one."""
    said = F.trim(F.coalesce(cell, F.lit("")))
    label = F.trim(F.substring(said, F.lit(8), F.length(said)))
    include = F.to_json(F.struct(F.lit("INCLUDE").alias("decision"), F.lit("").alias("tag")))
    exclude = F.to_json(F.struct(F.lit("EXCLUDE").alias("decision"), text.slug(label).alias("tag"), label.alias("tag_label")))
    maybe = F.to_json(F.struct(F.lit("MAYBE").alias("decision"), F.lit("").alias("tag"), said.alias("raw")))
    return F.when((said != "") & (F.lower(said) != "nan"), F.when(F.upper(said).startswith("INCLUDE"), include).when(F.upper(said).startswith("EXCLUDE"), exclude).otherwise(maybe))


def screening_upload(df: DataFrame) -> DataFrame:
    """(record_id, title, md_text, file_name, value_json) of an export of references: one row a record, the last of those with one id.

    Rows without an id have that of `row-` and their number from 0; rows without title and abstract are left out, but
    count. value_json is null where there is no decision yet.
    """
    decision = first_of(df, "ta_decision", "decision")
    rows = ranks.numbered(df.select(
        F.trim(first_of(df, "u1", "record_id", "id").cast("string")).alias("raw_id"), F.trim(first_of(df, "t1", "title")).alias("title"), F.trim(first_of(df, "ab", "abstract")).alias("abstract"),
        first_of(df, "a1", "author", "authors").alias("author"), first_of(df, "py", "year").cast("string").alias("year"), decision.cast("string").alias("decision"),
    ), "row")
    named = F.when(F.coalesce("raw_id", F.lit("")).isin("", "nan"), F.concat(F.lit("row-"), F.col("row").cast("string"))).otherwise(F.col("raw_id"))
    rows = rows.where("coalesce(title, '') <> '' OR coalesce(abstract, '') <> ''").withColumn("record_id", text.stable_id(named))
    found = rows.select(
        "record_id", "row", F.substring(F.coalesce("title", F.lit("")), 1, 255).alias("title"), text.record_markdown(F.col("title"), F.col("abstract"), F.col("author"), F.col("year")).alias("md_text"),
        F.concat(F.col("record_id").cast("string"), F.lit("_"), F.coalesce(F.nullif(text.slug(F.substring(F.coalesce("title", F.lit("")), 1, 50)), F.lit("")), F.col("record_id").cast("string")), F.lit(".md")).alias("file_name"),
        decision_object(F.col("decision")).alias("value_json"),
    )
    last = found.groupBy("record_id").agg(F.max_by(F.struct("title", "md_text", "file_name"), "row").alias("r"), F.max_by("value_json", F.when(F.col("value_json").isNotNull(), F.col("row"))).alias("value_json"))
    return last.select("record_id", "r.*", "value_json")


def decision_column(df: DataFrame, least: float = 0.4) -> str | None:
    """The column with the largest share of INCLUDE/EXCLUDE cells: over least, two or more values. One pass."""
    cell = lambda c: F.upper(F.trim(F.col(f"`{c}`").cast("string")))
    hit = lambda c: cell(c).startswith("INCLUDE") | cell(c).startswith("EXCLUDE")
    aggs = [x for i, c in enumerate(df.columns) for x in (F.try_divide(F.count_if(hit(c)), F.count_if(cell(c) != "")).alias(f"s{i}"), F.count_if(hit(c)).alias(f"n{i}"))]
    row = df.agg(*aggs).first()
    shares = [((row[f"s{i}"] or 0.0), -i) for i in range(len(df.columns)) if row[f"n{i}"] >= 2]
    best = max(shares, default=(0.0, 0))
    return df.columns[-best[1]] if best[0] > least else None


def log_tail(spark: SparkSession, path: str, n: int, block: int = 1 << 16) -> DataFrame:
    """(at, value) of the last n lines that aren't blank, newest last; n is held in 1..200.

    Reads blocks from the end of the file until they hold enough lines, in whatever store it is; never more of it.
    """
    n = max(1, min(200, n))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at, held = fs.getFileStatus(where).getLen(), b""
    stream = fs.open(where)
    try:
        while at:
            size = min(block, at)
            at -= size
            stream.seek(at)
            held = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) + held
            whole = held.split(b"\n")[1 if at else 0 :]  # the first line may have begun before
            if sum(bool(x.strip()) for x in whole) >= n:
                break
        else:
            whole = held.split(b"\n")
    finally:
        stream.close()
    lines = [x.rstrip(b"\r").decode("utf-8", "replace") for x in whole if x.strip()][-n:]
    return spark.createDataFrame(list(enumerate(lines)), "at int, value string")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(kind, parent, value) of a taxonomy file: countries, sectors, and sub-sectors by sector."""
    raw = spark.read.schema("countries array<string>, sectors array<string>, sub_sectors_by_sector map<string,array<string>>").option("multiLine", True).json(path)
    none = F.lit(None).cast("string")
    flat = [raw.select(F.lit(k).alias("kind"), none.alias("parent"), F.explode(k).alias("value")) for k in ("countries", "sectors")]
    sub = raw.select(F.explode("sub_sectors_by_sector").alias("parent", "values")).select(F.lit("sub_sectors").alias("kind"), "parent", F.explode("values").alias("value"))
    return flat[0].unionByName(flat[1]).unionByName(sub)


def model_roster(spark: SparkSession, roster: str) -> DataFrame:
    """(model_id, tier) from a YAML roster of tiers."""
    import yaml

    tiers = yaml.safe_load(roster) or {}
    rows = [(str(m["id"] if isinstance(m, dict) else m), tier) for tier, models in tiers.items() for m in models or []]
    return spark.createDataFrame(rows, "model_id string, tier string")
