"""Token counts, with overlap resynchronisation for huge documents.

Documents of up to chunk_chars characters are counted whole. A longer one is dealt out as overlapping
chunks, each encoded with offsets. Two neighbours are spliced at a position in their overlap where both
have a token start and white space stands before it: the vocabulary's pattern drops white space, so what
follows it is encoded alike whatever came before, and what precedes it whatever comes after. If
neighbours share no such position, the document's chunks and overlaps grow fourfold and it goes round
again; at the latest one chunk holds it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pretokens

#: Longer documents, in characters, are encoded by chunks of this size; neighbours share OVERLAP_CHARS.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024

#: Chunks that one task encodes.
CHUNKS_A_TASK = 100

CHUNKS = "rid long, chunk int, tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
_LOADED: dict = {}


def library(path: str):
    """One tokenizer for each worker process and path."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def boundaries(text: str, offsets: list[tuple[int, int]], low: int, high: int) -> tuple[list[int], list[int]]:
    """Positions in [low, high) where a token starts after white space, and the tokens before each."""
    at, n, last = [], [], -1
    for i, (start, _) in enumerate(offsets):
        if low <= start < high and start > 0 and start != last and text[start - 1] in common.WHITE and text[start] not in common.WHITE:
            at.append(start)
            n.append(i)
        last = start
    return at, n


def encode_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per chunk its tokens and the stable boundaries, as positions in the document, that each overlap holds."""
    schema = pa.schema([("rid", pa.int64()), ("chunk", pa.int32()), ("tokens", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("left_at", "left_n", "right_at", "right_n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(path)
        for batch in batches:
            rows = []
            for rid, chunk, begin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offsets = tokenizer.encode(text, add_special_tokens=False).offsets
                left = boundaries(text, offsets, 0, min(overlap, len(text)))
                right = boundaries(text, offsets, max(0, len(text) - overlap), len(text))
                shifted = [(np.array(at, np.int64) + begin, n) for at, n in (left, right)]
                rows.append((rid, chunk, len(offsets), *shifted[0], *shifted[1]))
            yield common.batch_of(schema, *zip(*rows, strict=True))

    return common.mapped(chunks.select("rid", "chunk", "begin", "text"), run, CHUNKS)


def spliced(found: DataFrame) -> DataFrame:
    """(rid, tokens): null if some neighbours share no stable boundary."""
    by = Window.partitionBy("rid").orderBy("chunk")
    common_at = F.array_min(F.array_intersect("right_at", F.lead("left_at").over(by)))
    place = lambda at, n, p: F.element_at(n, F.array_position(at, p).cast("int"))
    last = F.lead("chunk").over(by).isNull()
    chained = found.withColumn("p", common_at).withColumn("q", F.lag("p").over(by)).withColumn("last", last)
    # a chunk counts from the splice with its predecessor to the one with its successor
    until = F.when(F.col("last"), F.col("tokens")).when(F.col("p").isNotNull(), place(F.col("right_at"), F.col("right_n"), F.col("p")))
    since = F.when(F.col("chunk") == 0, F.lit(0)).when(F.col("q").isNotNull(), place(F.col("left_at"), F.col("left_n"), F.col("q")))
    part = until - since
    return chained.groupBy("rid").agg(F.when(F.count_if(part.isNull()) == 0, F.sum(part)).alias("tokens"))


def pieces(text: str, chunk: int, overlap: int) -> list[tuple[int, int, str]]:
    """(number, start, text) of overlapping chunks."""
    step = chunk - overlap
    last = max(0, -(-(len(text) - chunk) // step))
    return [(k, k * step, text[k * step : k * step + chunk]) for k in range(last + 1)]


def fourfold(chunks: DataFrame, step: int, overlap: int) -> DataFrame:
    """(rid, chunk, begin, text): four chunks in one each, and overlaps as much longer."""
    grouped = chunks.withColumn("last", F.lead("chunk").over(Window.partitionBy("rid").orderBy("chunk")).isNull())
    own = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, step))
    listed = F.sort_array(F.collect_list(F.struct("chunk", own.alias("own"))))
    merged = grouped.groupBy("rid", F.expr("chunk div 4").alias("chunk")).agg(F.min("begin").alias("begin"), F.array_join(F.transform(listed, lambda x: x["own"]), "").alias("own"))
    ahead = F.substring(F.lead("own").over(Window.partitionBy("rid").orderBy("chunk")), 1, 4 * overlap)
    return merged.select("rid", "chunk", "begin", F.concat("own", F.coalesce(ahead, F.lit(""))).alias("text"))


def count_long(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(rid, tokens) of documents in chunks (rid, chunk, begin, text)."""
    done, n = None, chunks.count()
    while n:
        dealt = chunks.repartition(1 + n // CHUNKS_A_TASK, F.xxhash64("rid", "chunk"))  # a few huge documents may lie in one split
        found = common.written(spliced(encode_chunks(dealt, path, overlap)), "token-chunks")
        ok = found.where("tokens IS NOT NULL")
        done = ok if done is None else done.unionByName(ok)
        left = found.where("tokens IS NULL").select("rid")
        if left.isEmpty():
            break
        chunks = common.written(fourfold(chunks.join(left, "rid", "left_semi"), chunk - overlap, overlap), "token-fourfold")
        chunk, overlap, n = 4 * chunk, 4 * overlap, chunks.count()
    return done


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per row of docs doc_id, n_bytes, n_tokens and whether it has more than limit tokens.

    A null text is empty: 0 bytes, 0 tokens. Texts of up to chunk characters are counted whole, longer ones
    in chunks that are cut where the text is read. doc_id may be null or repeat; each row counts on its own.
    An empty table gives no rows; other columns of docs are ignored.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("chunk", pa.int32()), ("begin", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pretokens.encoder(path)
        for batch in batches:
            texts = common.texts_of(batch)
            n = tokens.encode([x if len(x) <= chunk else "" for x in texts], counts_only=True)[1]
            n_bytes = [len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in texts]
            n_tokens = [int(k) if len(x) <= chunk else None for x, k in zip(texts, n, strict=True)]
            none = [None] * len(texts)
            yield common.batch_of(schema, batch.column(0), batch.column(1), n_bytes, n_tokens, none, none, none)
            for rid, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                parts = pieces(text, chunk, overlap) if len(text) > chunk else []
                for k in range(0, len(parts), CHUNKS_A_TASK):
                    part = parts[k : k + CHUNKS_A_TASK]
                    unset = [None] * len(part)
                    yield common.batch_of(schema, [rid] * len(part), unset, unset, unset, *zip(*part, strict=True))

    # written, so that the rows' numbers and the long texts stay what they are when a task runs again
    counted = common.written(common.mapped(rows, run, "rid long, doc_id long, n_bytes long, n_tokens long, chunk int, begin long, text string"), "token-counts")
    own = counted.where("chunk IS NULL")
    result = own.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")
    found = count_long(counted.where("chunk IS NOT NULL").select("rid", "chunk", "begin", "text"), path, chunk, overlap)
    if found is not None:
        rest = own.where("n_tokens IS NULL").select("rid", "doc_id", "n_bytes").join(found, "rid")
        result = result.unionByName(rest.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens")))
    return result.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
