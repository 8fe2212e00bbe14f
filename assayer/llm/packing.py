"""Concatenate and cut: all documents as one stream of tokens, cut into windows of equal length.

Pass one encodes every text once and writes the ids with the running total of tokens in its partition.
The partitions' totals, one row each, give by a prefix sum where each partition starts in the stream.
Pass two cuts every document at the windows' borders. No token is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pretokens

#: Partition totals that are broadcast, 16 bytes each; with more partitions Spark joins them.
BROADCAST_PARTS = 100_000

ENCODED = "part int, doc_id long, doc_tokens long, before long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """The ids of each text (null: empty), then end_id, with the tokens before it in its partition."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, total = pretokens.encoder(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], tokens.kind).tobytes()
        for batch in batches:
            ids, n = tokens.encode(common.texts_of(batch))
            ids, n = [x + end for x in ids], n + (end_id is not None)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield common.batch_of(schema, pa.array(np.full(len(n), part, np.int32)), batch.column(0), n, before, ids)

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, ENCODED)


def cut(encoded: DataFrame, window: int) -> DataFrame:
    """Pieces of the encoded documents, each within one window of the stream; rows without tokens give none."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, at, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, start = np.frombuffer(ids, f"<u{len(ids) // n}" if n else "<u4").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    rows.append((doc, start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset))
                    start += length
            yield common.batch_of(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    return common.mapped(encoded.select("doc_id", "doc_tokens", "at", "ids"), run, PIECES)


def pack(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int | None = 1) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in which sequence.

    Only the last sequence has padding. doc_id may be null or repeat: each row of docs is packed on its
    own, very long texts in parts. A null text is empty and still has its end id; with end_id None it gives no piece. An empty
    table gives no rows; other columns of docs are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    encoded = common.written(encode(docs, path, end_id), "packing")
    totals = common.written(encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")), "packing-totals")
    ahead = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(ahead, F.lit(0)).alias("part_start"))
    if totals.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    placed = encoded.join(starts, "part").withColumn("at", F.col("part_start") + F.col("before"))
    return cut(placed, window)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
