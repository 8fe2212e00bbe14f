"""Substring dedup by recompression, exact.

Rounds name runs and pairs of all texts (recompress.py). After each, Spark groups the new names over all
documents: a symbol that only one document has rules out every window of words that holds what the symbol
depends on, and goes; documents without a window left go too. What is left grows into longer symbols, so
that after the last round the windows left are those whose symbols, long ones among them, other documents
share. These windows alone are verified, by 128-bit hashes of their words: first whole blocks of them, which
symbols bound, so that a long repeat is a few rows; then single windows of blocks that no smaller document
has as a whole. Whole copies are told by a hash of all their words beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, recompress, wordhash
from .recompress import Symbols

#: Odd bases of the two window hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Characters of texts that are parsed together.
GROUP_CHARS = 2_500_000
#: One symbol in so many, a power of two, ends a block of windows.
CUT = 4
#: Ids that are broadcast to find documents by, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: A document: num numbers the rows, so that those that repeat an id are apart; its text is known by 128 bits of its words.
DOC = ["num", "doc_id", "copy_a", "copy_b", "n_words"]
#: Symbols by their names, the words before each that no symbol spans, its words, how far it depends on those around it, and windows by ranges of starts.
LISTS = ("gaps", "lengths", "before", "after", "ranges")
STATE = "num long, doc_id long, copy_a long, copy_b long, n_words long, names array<long>, fresh array<boolean>, " + ", ".join(f"{x} array<int>" for x in LISTS)
STATE_SCHEMA = pa.schema([*((x, pa.int64()) for x in DOC), ("names", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_())), *((x, pa.list_(pa.int32())) for x in LISTS)])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def span_hashes(words: np.ndarray, since: np.ndarray, until: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of words[since:until] for each pair of bounds."""
    found = []
    for base in BASES:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mixed(words ^ base) * powers(base, len(words)))])
        value = (sums[until] - sums[since]) * powers(inverse(base), len(words) + 1)[since]
        found.append(wordhash.mixed(value + (until - since).astype(np.uint64) * base).view(np.int64))
    return found


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes, and where each text starts in them, and their number."""
    words = [words_of(x) for x in texts]
    return wordhash.hashes([w for x in words for w in x]), np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)])


def grouped(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about GROUP_CHARS characters."""
    since, held = 0, 0
    for k, text in enumerate(common.texts_of(batch)):
        held += len(text)
        if held >= GROUP_CHARS:
            yield batch.slice(since, k + 1 - since)
            since, held = k + 1, 0
    if since < batch.num_rows:
        yield batch.slice(since)


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def packed(doc: list[pa.Array], s: Symbols, alive: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    """STATE of documents that start at the words base, the last of which is the number of words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.astype(np.int8), [0]])))
    n_symbols = np.diff(np.searchsorted(s.start, base))
    n_edges = np.diff(np.searchsorted(edge[::2], base)) * 2
    last = np.append(0, s.end[:-1])
    at = (np.cumsum(n_symbols) - n_symbols)[n_symbols > 0]
    last[at] = base[:-1][n_symbols > 0]
    values = {"gaps": s.start - last, "lengths": s.end - s.start, "before": s.start - s.low, "after": s.high - s.end}
    lists = [list_of(s.name.view(np.int64), n_symbols, pa.int64()), list_of(s.fresh, n_symbols, pa.bool_())]
    lists += [list_of(values[x].astype(np.int32), n_symbols, pa.int32()) for x in LISTS[:-1]]
    lists.append(list_of((edge - np.repeat(base[:-1], n_edges)).astype(np.int32), n_edges, pa.int32()))
    return pa.RecordBatch.from_arrays([*doc, *lists], schema=STATE_SCHEMA)


def unpacked(batch: pa.RecordBatch) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """The symbols of all documents on one axis of words, a word apart; which windows are alive; where documents start."""
    base = np.concatenate([[0], np.cumsum(batch.column("n_words").to_numpy() + 1)])
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    counts = batch.column("names").value_lengths().to_numpy()
    step = flat("gaps").astype(np.int64) + flat("lengths")
    upto = np.cumsum(step)
    at = np.cumsum(counts) - counts
    end = upto + np.repeat(base[:-1] - np.append(0, upto)[at], counts)
    start = end - flat("lengths")
    bounds = flat("ranges").reshape(-1, 2) + np.repeat(base[:-1], batch.column("ranges").value_lengths().to_numpy() // 2)[:, None]
    change = np.zeros(base[-1] + 1, np.int8)
    change[bounds[:, 0]] += 1
    change[bounds[:, 1]] -= 1
    return Symbols(flat("names").view(np.uint64), start, end, start - flat("before"), end + flat("after"), flat("fresh").astype(bool)), np.cumsum(change)[:-1] > 0, base


def survey(docs: DataFrame, window: int) -> DataFrame:
    """STATE after the first round, and whole_sha, n_words of each row; copy_a is null for texts of fewer words than a window."""
    schema = pa.schema([*STATE_SCHEMA, ("whole_sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in grouped(batch):
                words = [words_of(x) for x in common.texts_of(part)]
                n = np.array([len(x) for x in words], np.int64)
                sha = [hashlib.sha256(b" ".join(x)).hexdigest() for x in words]
                is_long = n >= window
                hashes = wordhash.hashes([w for x, long in zip(words, is_long, strict=True) if long for w in x])
                at = np.concatenate([[0], np.cumsum(n * is_long)])
                first = np.zeros(len(hashes), bool)
                first[at[:-1][is_long]] = True
                every = recompress.parse(hashes, first) if len(hashes) else recompress.runs(hashes, first)
                change = np.zeros(len(hashes) + 1, np.int32)
                change[at[:-1][is_long]] += 1
                np.add.at(change, (at[1:] - window + 1)[is_long], -1)
                copy = [pa.array(x, pa.int64(), mask=~is_long) for x in span_hashes(hashes, at[:-1], at[1:])] if len(hashes) else [pa.nulls(len(n), pa.int64())] * 2
                doc = [pa.array(num + np.arange(len(n))), part.column(0), *copy, pa.array(n)]
                num += len(n)
                found = packed(doc, every, np.cumsum(change)[:-1] > 0, at)
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(sha)], schema=schema)

    return common.written(common.mapped(docs, run, f"{STATE}, whole_sha string"), "substring-survey")


def telling_names(state: DataFrame, window: int) -> DataFrame:
    """(num, doc_id, symbol): the names that this round asks the other documents for."""
    each = state.select("num", "doc_id", F.explode(F.arrays_zip("names", "fresh", "lengths", "before", "after")).alias("s"))
    asked = each.where(f"s.fresh AND s.lengths >= {recompress.LEAST} AND s.lengths + s.before + s.after <= {window}")
    return asked.select("num", "doc_id", F.col("s.names").alias("symbol"))


def next_round(state: DataFrame, shared: DataFrame, window: int, turn: int) -> DataFrame:
    """STATE after the round, of documents that have a window left. shared: (num, shared), the names that others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, alive, base = unpacked(batch)
            known = np.unique(batch.column("shared").flatten().to_numpy(zero_copy_only=False))
            dead = s.telling(window) & ~np.isin(s.name.view(np.int64), known)
            alive &= recompress.covered(s.low[dead], s.high[dead], len(alive), window) == 0
            s = s[~dead]
            s = s[recompress.held(s, alive, window)]
            if turn < len(recompress.ROUNDS):
                starts, ends = np.zeros(base[-1] + 1, bool), np.zeros(base[-1] + 1, bool)
                starts[base[:-1]], ends[base[1:] - 1] = True, True
                s = recompress.pairs(s, starts, ends, turn)
            found = packed([batch.column(x) for x in DOC], s, alive, base)
            left = pa.compute.greater(found.column("ranges").value_lengths(), 0)
            if pa.compute.any(left).as_py():
                yield found.filter(left)

    found = state.join(shared, "num", "left").select(*STATE_SCHEMA.names, F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))
    return common.written(common.mapped(found, run, STATE), "substring-state")


def rounds(state: DataFrame, window: int) -> DataFrame:
    """The documents and windows that are left when all rounds have been asked for."""
    for turn in range(1, len(recompress.ROUNDS) + 1):
        each = telling_names(state, window)
        named = each.groupBy("symbol").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        named = common.written(named.select("symbol", "n"), "substring-names")
        total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shared = common.join_hot(each.select("num", "symbol"), named, ["symbol"], "n", total).groupBy("num").agg(F.collect_set("symbol").alias("shared"))
        state = next_round(state, shared, window, turn)
    return state.select(*DOC, "ranges")


def texts_of_windows(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(num, doc_id, text, ranges) of the rows that have windows left, found by id and then by content."""
    ids = common.written(left.select("doc_id").distinct(), "substring-ids")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    schema = pa.schema([("num", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("ranges", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch):
                hashes, at = hashed_words(common.texts_of(part))
                one, two = span_hashes(hashes, at[:-1], at[1:]) if len(hashes) else (np.zeros(part.num_rows, np.int64),) * 2
                same = (one == part.column("copy_a").to_numpy()) & (two == part.column("copy_b").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(x) for x in schema.names], schema=schema).filter(pa.array(same))

    found = docs.join(left, "doc_id").select("num", "doc_id", "text", "ranges", "copy_a", "copy_b")
    return common.written(common.mapped(found, run, "num long, doc_id long, text string, ranges array<int>"), "substring-texts")


def starts_of(lists: pa.ListArray, base: np.ndarray) -> np.ndarray:
    """Which starts, on the axis of all documents' words, the ranges hold."""
    r = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2) + np.repeat(base[:-1], lists.value_lengths().fill_null(0).to_numpy() // 2)[:, None]
    change = np.zeros(base[-1] + 1, np.int32)
    np.add.at(change, r[:, 0], 1)
    np.add.at(change, r[:, 1], -1)
    return np.cumsum(change)[:-1] > 0


HASHED = "a long, b long, num long, doc_id long, since int, until int"
HASHED_SCHEMA = pa.schema([*((x, pa.int64()) for x in ("a", "b", "num", "doc_id")), ("since", pa.int32()), ("until", pa.int32())])


def hashed_spans(part: pa.RecordBatch, hashes: np.ndarray, base: np.ndarray, since: np.ndarray, until: np.ndarray, window: int) -> pa.RecordBatch:
    """HASHED of the windows that start in since:until, on the axis of all documents' words."""
    doc = np.searchsorted(base, since, side="right") - 1
    own = [part.column(x).to_numpy()[doc] for x in ("num", "doc_id")]
    return common.batch_of(HASHED_SCHEMA, *span_hashes(hashes, since, until + window - 1), *own, (since - base[doc]).astype(np.int32), (until - base[doc]).astype(np.int32))


def blocks_left(texts: DataFrame, window: int) -> DataFrame:
    """HASHED: the windows that are left in blocks of neighbours, cut where certain symbols start, hashed as a whole.

    Symbols stand at the same places in copies, so long repeats are blocks of equal words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch):
                hashes, base = hashed_words(common.texts_of(part))
                alive = starts_of(part.column("ranges"), base)
                first = np.zeros(len(hashes), bool)
                first[base[:-1]] = True
                s = recompress.parse(hashes, first)
                begin = alive & np.append(True, ~alive[:-1])
                begin[s.start[(s.name & np.uint64(CUT - 1)) == 0]] = True
                since = np.flatnonzero(begin & alive)
                edge = np.flatnonzero(alive & np.append(~alive[1:], True)) + 1  # where ranges end
                until = np.minimum(np.append(since[1:], len(alive)), edge[np.searchsorted(edge, since, side="right")])
                yield hashed_spans(part, hashes, base, since, until, window)

    return common.mapped(texts, run, HASHED)


def windows_left(texts: DataFrame, window: int) -> DataFrame:
    """HASHED of each window of the ranges that no settled block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch):
                hashes, base = hashed_words(common.texts_of(part))
                since = np.flatnonzero(starts_of(part.column("ranges"), base) & ~starts_of(part.column("settled"), base))
                yield hashed_spans(part, hashes, base, since, since + 1, window)

    return common.mapped(texts, run, HASHED)


def repeated(hashed: DataFrame) -> DataFrame:
    """(num, ranges): the starts of each document whose words a smaller document has too."""
    hashed = common.written(hashed, "substring-hashed")
    first = hashed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.written(first, "substring-repeats")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = common.join_hot(hashed, first, ["a", "b"], "n", total).where("doc_id > first")
    found = again.groupBy("num").agg(F.flatten(F.collect_list(F.array("since", "until"))).alias("ranges"))
    found = common.written(found, "substring-again")
    common.discard(hashed)
    return found


def trimmed(texts: DataFrame, window: int) -> DataFrame:
    """(num, n_removed, kept_sha256): texts without the words of the windows that start in the ranges."""
    schema = pa.schema([("num", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for num, text, ranges in zip(batch.column(0).to_pylist(), common.texts_of(batch), batch.column(2), strict=True):
                words, r = words_of(text), ranges.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, r[:, 0], 1)
                np.add.at(change, r[:, 1] - 1 + window, -1)
                kept = (np.cumsum(change)[: len(words)] == 0).nonzero()[0].tolist()
                rows.append((num, len(words) - len(kept), hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest()))
            yield common.batch_of(schema, *zip(*rows, strict=True))

    return common.mapped(texts, run, "num long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of docs doc_id, n_words, n_removed and the hash of the words that stay.

    A word goes if a window of that many words covers it whose words also start in a document with a
    smaller doc_id. A null text has no words; texts shorter than a window lose none; very long texts are
    read whole. A row with a null doc_id loses none and counts for no other. Rows that repeat a doc_id are
    each judged by their own text, none of them by another of that id. An empty table gives no rows; other
    columns of docs are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    surveyed = survey(docs, window)
    rows = common.written(surveyed.select(*DOC, "whole_sha"), "substring-rows")
    known = rows.where("copy_a IS NOT NULL AND doc_id IS NOT NULL")
    copies = known.groupBy("copy_a", "copy_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    copies = common.written(copies, "substring-copies")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = common.join_hot(known.select("num", "doc_id", "copy_a", "copy_b"), copies, ["copy_a", "copy_b"], "n", total).where("doc_id > first").select("num")
    gone = common.written(gone, "substring-gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone

    state = surveyed.where("copy_a IS NOT NULL AND doc_id IS NOT NULL").join(few, "num", "left_anti").select(*STATE_SCHEMA.names)
    left = rounds(state, window)
    common.discard(surveyed)
    texts = texts_of_windows(docs.where("doc_id IS NOT NULL"), left)
    settled = repeated(blocks_left(texts, window))
    # a window's smallest document never has it in a settled block: so single windows are asked for only elsewhere
    single = repeated(windows_left(texts.join(settled.withColumnRenamed("ranges", "settled"), "num", "left"), window))
    ranges = settled.unionByName(single).groupBy("num").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    ranges = common.written(ranges, "substring-ranges")
    if ranges.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ranges.select("num")), "num", "left_semi")
    cut = trimmed(texts.drop("ranges").join(ranges, "num").select("num", "text", "ranges"), window)

    all_gone = gone.select("num", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    changed = common.written(cut.dropDuplicates(["num"]).unionByName(all_gone), "substring-changed")
    joined = rows.join(changed.withColumn("changed", F.lit(True)), "num", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("changed"), F.coalesce("n_removed", "n_words")).otherwise(0).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha").alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
