"""What the training-data operators share: tables, durable intermediates, batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the contracts: space and x09 to x0D.
WHITE = " \t\n\x0b\f\r"

#: Rows and bytes of an Arrow batch; texts are long, so Spark's default of 10,000 rows is too many.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches, so that a batch of very long texts doesn't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result.folder = path
    return result


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with bounded batches. function takes and yields record batches."""
    tuned(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(x for x in batches if x.num_rows)

    return df.mapInArrow(run, schema)


def is_star_forest(link: DataFrame) -> bool:
    """If every a has one b and no b is an a: then b is its component."""
    ends = link.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(link.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that links a, b reach; only nodes that have a link.

    Alternates large-star and small-star steps until only stars are left. Each step's edges are a table in
    the shared folder, so that no lineage grows and the joins on a hot node read two fresh exchanges, which
    AQE can split. The driver learns only whether a step was the last.
    """
    link = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    link = written(link, name)
    while not is_star_forest(link):
        both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        # large-star: every larger neighbour of a node is tied to the node's smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), name)
        # small-star: every smaller neighbour, and the node itself, is tied to its smallest neighbour
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        tied = large.join(least, "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        link = written(small.where("a <> b").distinct(), name)
    return link.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(link.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Keys that are broadcast as hot ones at most: each stands for more than this part of all rows.
HOT_KEYS = 10_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column n says how many of left's total rows have each.

    Keys with more than total / HOT_KEYS rows, of which there are at most HOT_KEYS, are broadcast, so that
    no task gets all rows of one; the others are joined by a shuffle.
    """
    is_hot = F.col(n) > total / HOT_KEYS
    if right.where(is_hot).isEmpty():
        return left.join(right, keys, how)
    met = left.join(F.broadcast(right.where(is_hot).withColumn("_hot", F.lit(True))), keys, "left")
    cold = met.where("_hot IS NULL").select(*left.columns).join(right.where(~is_hot), keys, how)
    return met.where("_hot").drop("_hot").unionByName(cold)


#: Ids that are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number for each row, written so that the numbers stay what they are."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """numbered docs without the rows of these numbers (column _row), and without the numbers."""
    gone = written(gone.select("_row"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "_row", "left_anti").drop("_row")
