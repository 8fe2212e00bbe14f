"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The merging itself is in bpe.py, the pre-tokens and the memo in pretokens.py: both in numpy inside tasks
that Spark deals out by the table's own splits; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, pretokens

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def decode_bytes(merger: bpe.Merger, ids: np.ndarray) -> bytes:
    """The bytes that the ids stand for, special tokens as their strings."""
    return b"".join(map(merger.bytes_of.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs its ids (little-endian unsigned 32-bit) and the text they decode to.

    A null text is empty and gives no ids; bytes that aren't UTF-8 decode to U+FFFD. doc_id may be null
    or repeat. Very long texts are encoded in parts. An empty table gives no rows; other columns of docs are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pretokens.encoder(path)
        for batch in batches:
            ids, n = tokens.encode(common.texts_of(batch))
            ids = [np.frombuffer(x, tokens.kind) for x in ids]
            decoded = [decode_bytes(tokens.merger, x).decode("utf-8", "replace") for x in ids]
            yield common.batch_of(schema, batch.column(0), n, [x.astype("<u4").tobytes() for x in ids], decoded)

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, ENCODED)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
