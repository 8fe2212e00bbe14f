"""Line dedup that can be taken back: sharded cuckoo filters beside exact reference-count tables.

The index has three tables in the shared folder. references: a row for each row of documents and distinct key
in it. counts: of each key the rows that hold it and their smallest and largest doc_id. filters: for each
shard of keys a cuckoo filter of those in counts. Insertion groups a load's references by key and looks the
keys up in the filters, shard by shard: those that no filter has are new and settled; only the others meet
counts in a join. Deletion takes documents' references away, counts the keys that they held anew, and removes
from the filters those that nobody holds any more, so that the index is what it was without these documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, cuckoo

#: Code points of a key that counts, at least; loads of a bulk insertion; keys of a shard and shards at least.
LEAST_POINTS, LOADS, SHARD_KEYS, SHARDS = 10, 2, 1 << 15, 256

KEY, ROW = ["a", "b"], ["ra", "rb"]
COUNTS = "shard int, a long, b long, refs long, first long, last long, unnamed long"


def keyed(text: str, least: int) -> tuple[list[str], list[bytes | None]]:
    """The lines, and of each its key's 128-bit hash, none if the key is short. str.lower would change more than A-Z."""
    lines, keys = text.split("\n"), []
    for line in lines:
        key = line.strip(common.WHITE)
        keys.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None)
    return lines, keys


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ra, rb): 128 bits that name a row by its content, so that no row must be numbered."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64("doc_id", "text").alias("ra"), F.xxhash64(F.lit(1), "doc_id", "text").alias("rb"))


def references(docs: DataFrame, least: int) -> DataFrame:
    """(a, b, doc_id, ra, rb) of each named row and distinct key."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "doc_id", "ra", "rb")])

    def run(batches):
        for batch in batches:
            keys = [list({k for k in keyed(text, least)[1] if k}) for text in common.texts_of(batch)]
            times = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            words = np.frombuffer(b"".join(k for row in keys for k in row), np.int64).reshape(-1, 2)
            kept = [batch.column(batch.schema.get_field_index(c)).take(times) for c in ("doc_id", "ra", "rb")]
            yield common.batch_of(schema, words[:, 0], words[:, 1], *kept)

    return common.mapped(docs, run, "a long, b long, doc_id long, ra long, rb long")


def by_key(refs: DataFrame, shards: int) -> DataFrame:
    """The counts of references: rows, smallest and largest doc_id, rows without doc_id."""
    found = refs.groupBy(*KEY).agg(
        F.count("*").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("unnamed")
    )
    return found.select(F.pmod("a", F.lit(shards)).cast("int").alias("shard"), *KEY, "refs", "first", "last", "unnamed")


def chain_of(filters: pa.Table) -> list[np.ndarray]:
    """A shard's tables in the order in which they were added."""
    found = sorted(zip(filters.column("link").to_pylist(), filters.column("slots").to_pylist(), strict=True))
    return [np.frombuffer(slots, np.uint16).reshape(-1, cuckoo.SLOTS) for _, slots in found]


def changed_filters(keys: DataFrame, filters: DataFrame, change: str) -> DataFrame:
    """The filters after keys, each once, were inserted or removed; insertion leaves out those that the filters may
    have, and marks them. Rows of keys have link -1 and say in known if the filters may have them; the others are
    tables. change: insert, force (all are inserted) or remove.
    """
    schema = pa.schema([("shard", pa.int32()), ("link", pa.int32()), ("slots", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("known", pa.bool_())])

    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        a, b = (keys.column(c).to_numpy().astype(np.int64) for c in KEY)
        chain = chain_of(filters)
        shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
        known = cuckoo.contains(chain, a, b) if change == "insert" else np.zeros(len(a), bool)
        after = cuckoo.remove(chain, a, b) if change == "remove" else cuckoo.insert(chain, a[~known], b[~known])
        n, told = len(after), np.flatnonzero(known)
        none = [None] * len(told)
        return pa.table(
            [[shard] * (n + len(told)), [*range(n), *[-1] * len(told)], [*(t.tobytes() for t in after), *none], [*[None] * n, *a[told].tolist()], [*[None] * n, *b[told].tolist()], [*[None] * n, *[True] * len(told)]],
            schema=schema,
        )

    told = keys.select("shard", *KEY).groupBy("shard").cogroup(filters.groupBy("shard"))
    return told.applyInArrow(run, "shard int, link int, slots binary, a long, b long, known boolean")


@dataclass
class LineIndex:
    """Tables in the shared folder; insert and delete give a new index and leave this one as it is.

    runs are counts: a key has a row in each run that came when it was known, and the rows are added up. again
    names the keys that have several.
    """

    least: int
    shards: int
    references: DataFrame
    filters: DataFrame
    runs: list[DataFrame] = field(default_factory=list)
    again: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def empty(spark: SparkSession, least: int = LEAST_POINTS, shards: int = SHARDS) -> LineIndex:
        none = spark.createDataFrame([], "a long, b long, doc_id long, ra long, rb long")
        return LineIndex(least, shards, none, spark.createDataFrame([], "shard int, link int, slots binary"))

    def insert(self, refs: DataFrame) -> LineIndex:
        """With these references, a load; they are read again later, so they should be a written table."""
        batch = common.written(by_key(refs, self.shards), "line-counts")
        told = common.written(changed_filters(batch, self.filters, "insert"), "line-filters")
        tables = told.where("link >= 0").select("shard", "link", "slots")
        maybe, again = told.where("known").select(*KEY), []
        if self.runs and not maybe.isEmpty():
            old = reduce(DataFrame.unionByName, [r.select(*KEY) for r in self.runs])
            held = old.join(maybe, KEY, "left_semi").distinct()
            again = [held := common.written(held, "line-again")]
            strays = common.written(maybe.join(held, KEY, "left_anti").withColumn("shard", F.pmod("a", F.lit(self.shards)).cast("int")), "line-strays")
            if not strays.isEmpty():  # fingerprints of other keys: they are new all the same
                tables = common.written(changed_filters(strays, tables, "force").select("shard", "link", "slots"), "line-filters")
        return LineIndex(self.least, self.shards, self.references.unionByName(refs), tables, [*self.runs, batch], [*self.again, *again])

    def counts(self) -> DataFrame:
        """A row a key: only those that came again are grouped, the others are as their run has them."""
        rows = reduce(DataFrame.unionByName, self.runs) if self.runs else self.references.sparkSession.createDataFrame([], COUNTS)
        if not self.again:
            return rows
        again = reduce(DataFrame.unionByName, self.again).distinct()
        added = rows.join(again, KEY, "left_semi").groupBy("shard", *KEY).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("unnamed").alias("unnamed"))
        return rows.join(again, KEY, "left_anti").select(*added.columns).unionByName(added)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of these ids (doc_id): the index as if they had never been inserted."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = self.references.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        gone = common.written(gone, "line-gone")
        refs = common.written(self.references.join(ids, "doc_id", "left_anti").select(*self.references.columns), "line-references")
        anew = common.written(by_key(refs.join(gone, KEY, "left_semi"), self.shards), "line-anew")
        unheld = gone.join(anew, KEY, "left_anti").withColumn("shard", F.pmod("a", F.lit(self.shards)).cast("int"))
        tables = common.written(changed_filters(unheld, self.filters, "remove").select("shard", "link", "slots"), "line-filters")
        run = self.counts().join(gone, KEY, "left_anti").select(*anew.columns).unionByName(anew)
        return LineIndex(self.least, self.shards, refs, tables, [common.written(run, "line-counts")])

    def dropped(self) -> DataFrame:
        """(ra, rb, keys): of each row the keys whose lines go, as another document that holds them stands before it."""
        shared = self.counts().where("first < last OR unnamed > 0 AND first IS NOT NULL")
        shared = common.written(shared.select(*KEY, "refs", "first"), "line-shared")
        total = self.references.count()
        met = common.join_hot(self.references, shared, KEY, "refs", total).where("NOT doc_id <=> first")
        return met.groupBy(*ROW).agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def built(docs: DataFrame, least: int, loads: int) -> LineIndex:
    """The index of named documents, inserted in so many loads."""
    refs = common.written(references(docs, least), "line-references")
    shards = max(SHARDS, 1 << (refs.count() // SHARD_KEYS).bit_length())
    index = LineIndex.empty(docs.sparkSession, least, shards)
    for k in range(loads):
        index = index.insert(refs.where(F.pmod("ra", F.lit(loads)) == k))
    index.references = refs
    return index


def kept_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Per named row doc_id, n_lines, n_dropped and kept, the text of the lines that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
    least = index.least

    def run(batches):
        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("keys"))
            found = []
            for k, text in enumerate(common.texts_of(batch)):
                if not sets[k].is_valid:
                    found.append((text.count("\n") + 1, 0, text))
                    continue
                pairs = sets[k].values
                gone = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], axis=1).tobytes()
                gone = {gone[i : i + 16] for i in range(0, len(gone), 16)}
                lines, keys = keyed(text, least)
                stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
                found.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
            yield common.batch_of(schema, batch.column(batch.schema.get_field_index("doc_id")), *zip(*found, strict=True))

    return common.mapped(docs.join(index.dropped(), ROW, "left").select("doc_id", "text", "keys"), run, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup(docs: DataFrame, least: int = LEAST_POINTS, loads: int = LOADS) -> DataFrame:
    """Per row of docs (doc_id, text) its lines, those dropped, and the text that is left.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys are told apart by 128-bit
    hashes. A key of at least so many code points that several doc_ids hold loses its lines but those in the
    smallest; repeated lines there all stay. A null or empty text is one empty line. Rows that repeat a doc_id are
    one document in this; rows without doc_id are one too, after all others. Very long texts and lines are read
    whole. An empty table gives no rows; other columns are ignored.
    """
    rows = named(docs)
    return kept_lines(rows, built(rows, least, loads))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = {
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, s.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM k LEFT JOIN s USING (key)) GROUP BY id"""
}
