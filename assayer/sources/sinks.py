"""Writers. Parquet files don't change: updates make a new snapshot, appends add files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with new rows in place of those with their keys; of new rows with one key the last by order, or else the greatest.

    old moves to one anti-join; new is cut to a row a key before.
    """
    values = [c for c in new.columns if c not in keys]
    by = F.struct(*([order] if order else []), *values)
    last = new.groupBy(*keys).agg(F.max(F.struct(by.alias("by"), F.struct(*values).alias("row"))).alias("last")).select(*keys, "last.row.*") if values else new.dropDuplicates(keys)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_matching(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def fill_null(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), value))


def keep_baselines(versions: DataFrame) -> DataFrame:
    """What a reset leaves: the shared first versions."""
    return versions.where("version = 1 AND model_id IS NULL")


def migrate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, null, of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def without_nul(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.translate(c, "\u0000", "") for c, t in df.dtypes if t == "string"})


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a row, Unicode as it is, null fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def chat(system: str, user: str, assistant: str) -> Column:
    """The three turns of a training example."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def chat_rows(df: DataFrame, system: str, user: str, assistant: str) -> DataFrame:
    return df.select(chat(system, user, assistant).alias("messages"))


def valid_chat(df: DataFrame, key: str) -> DataFrame:
    """Whether a chat row has its three roles in order and a target with the key."""
    roles = F.transform("messages", lambda m: m["role"])
    target = F.try_variant_get(F.try_parse_json(F.element_at("messages", -1)["content"]), f"$.{key}", "variant")
    return df.withColumn("valid", (roles == F.array(*[F.lit(r) for r in ("system", "user", "assistant")])) & target.isNotNull())


def subset(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables' rows of the given records."""
    return {name: df.join(ids.select(key).distinct(), key, "left_semi") if key in df.columns else df for name, df in tables.items()}
