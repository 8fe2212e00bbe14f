"""Vector code compression: product codes of integer vectors, exact in 64-bit integers.

Components are made whole numbers once and kept as a table. In each round the codebooks, some thousand
numbers, are broadcast; a task compares its Arrow batches with all entries of a part at a time, by the
expansion of the squared norm into int64 matrix products, takes the first of the nearest, and adds up what
each entry got. The tasks' sums meet in a grouped shuffle, of which the driver reads one row an entry and component.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Parts of a vector, entries of a part's codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components up to this size can't overflow int64 in a part's products, if it has up to 2^10 components;
#: batches with larger ones are computed in Python's integers. Beyond LARGEST nothing is computed.
NARROW, LARGEST, MAX_LONG = 1 << 23, 1 << 60, (1 << 63) - 1

_LONG = "CAST(CASE WHEN {0} > 9223372036854775807BD THEN 9223372036854775807BD ELSE {0} END AS BIGINT)"


def whole_components(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of each component; rows without a finite vector are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("x IS NOT NULL AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    wide = F.lit(f"a component times {scale} is beyond 2^60: its squared distances fit no long")
    q = F.transform("x", lambda c: F.when(F.abs(c * scale) >= float(LARGEST), F.raise_error(wide).cast("long")).otherwise(F.floor(c * scale)))
    return common.written(rows.select("vec_id", "label", q.alias("q")), "vector-rows")


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors side by side, shorter ones filled up with zeros; Python's integers if some are large."""
    lists = batch.column(batch.schema.get_field_index("q"))
    n, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    if len(n) and (n == width).all():
        out = values.reshape(len(n), width)
    else:
        out = np.zeros((len(n), width), np.int64)
        out[np.repeat(np.arange(len(n)), n), np.concatenate([*(np.arange(k) for k in n), np.zeros(0, np.int64)]).astype(np.int64)] = values
    return out.astype(object) if out.size and max(int(out.max()), -int(out.min())) > NARROW else out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row and part; of entries equally near the first."""
    parts, entries, d = books.shape
    if x.dtype == object or d > 1 << 10 or books.size and max(int(books.max()), -int(books.min())) > NARROW:
        x, books = x.astype(object), books.astype(object)
    else:
        books = books.astype(np.int64)
    at, off = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), x.dtype)
    for p in range(parts):
        own, book = x[:, p * d : (p + 1) * d], books[p]
        to = (book * book).sum(axis=1)[None, :] - 2 * (own @ book.T) if d else np.zeros((len(x), entries), np.int64)
        at[:, p] = first = np.argmin(to, axis=1)
        off[:, p] = to[np.arange(len(x)), first] + ((own * own).sum(axis=1) if d else 0)
    return at, off


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """[part, entry, component]: the parts of the rows with the smallest vec_ids; those without come last."""
    starts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    found = np.zeros((len(starts), width), np.int64)
    for k, r in enumerate(starts):
        found[k, : len(r.q)] = r.q
    return found.reshape(len(starts), parts, width // parts).transpose(1, 0, 2).astype(object)


def entry_sums(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, at, total, n) of what each entry got: a row an entry, and component of it, over all tasks."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches):
        books = held.value
        parts, entries, d = books.shape
        sums, counts = np.zeros((parts, entries, d), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch, width)
            at, _ = nearest(x, books)
            for p in range(parts):
                counts[p] += np.bincount(at[:, p], minlength=entries)
                got = np.zeros((entries, d), x.dtype)
                np.add.at(got, at[:, p], x[:, p * d : (p + 1) * d])
                sums[p] += got
        some = [(p, e) for p in range(parts) for e in range(entries) if counts[p, e]]
        if some:
            decimals = [[Decimal(int(v)) for v in sums[p, e]] for p, e in some]
            yield common.batch_of(schema, [p for p, _ in some], [e for _, e in some], [int(counts[x]) for x in some], decimals)

    told = common.mapped(rows.select("q"), run, "part int, entry int, n long, sums array<decimal(38,0)>")
    told = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "total"))
    return told.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moved(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after a round: each entry the floor of its parts' mean; unused ones stay."""
    books = books.copy()
    for r in entry_sums(rows, books, width).toLocalIterator():  # a row each of the codebooks' numbers at most
        books[r.part, r.entry, r.at] = int(r.total) // r.n
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per kept row of vectors (vec_id, embedding, label) its code, error, label_error, and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out. Vectors shorter than the longest,
    and all if the parts would be unequal, count as filled up with zeros; an empty vector has parts without
    components, or zeros. Rows that repeat a vec_id are vectors of their own, among the first in the order of
    their components; rows without vec_id come last there. With fewer rows than entries the codebooks are
    smaller. An entry is two hex digits, so entries is 256 at most. Equal labels of any type, and null ones,
    share a label_error. Errors beyond a long are given as the largest; components beyond 2^60 after scaling
    raise an error. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries is 1 to 256")
    rows = whole_components(vectors, scale)
    longest = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    width = -(-longest // parts) * parts
    books = first_books(rows, parts, entries, width)
    for _ in range(rounds if books.shape[1] else 0):
        books = moved(rows, books, width)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    held = rows.sparkSession.sparkContext.broadcast(books)
    names = [f.name for f in rows.schema if f.name != "q"]

    def run(batches):
        for batch in batches:
            at, off = nearest(matrix(batch, width), held.value)
            codes = [bytes(row).hex() for row in at.astype(np.uint8)]
            errors = [min(int(e), MAX_LONG) for e in off.sum(axis=1)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    label = rows.select("label").schema[0].dataType.simpleString()
    coded = common.mapped(rows, run, f"vec_id long, label {label}, code string, error long")
    key = [F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("named")]
    coded = common.written(coded.select("vec_id", *key, "code", "error"), "vector-codes")
    label_sums = coded.groupBy("unlabelled", "named").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    label_sums = common.written(label_sums.select("unlabelled", "named", "n", F.expr(_LONG.format("total")).alias("label_error")), "vector-labels")
    total = label_sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = common.join_hot(coded, label_sums, ["unlabelled", "named"], "n", total)
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as common table expressions, by plain squared differences."""
    out = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cut AS (
  SELECT rid, vec_id, label, part, list_slice(q, part * (len(q) // {PARTS}) + 1, (part + 1) * (len(q) // {PARTS})) AS v FROM kept, range({PARTS}) t(part)
), book0 AS (
  SELECT part, entry, v FROM cut JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM kept) USING (rid) WHERE entry < {ENTRIES}
)"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        out.append(f"""at{k} AS (
  SELECT rid, part, arg_min(struct_pack(entry := entry, off := off), struct_pack(off := off, entry := entry)) AS best FROM (
    SELECT rid, c.part, entry, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i]))) AS off
    FROM cut c JOIN book{k} b ON c.part = b.part) GROUP BY rid, part
)""")  # fmt: skip
        if k < ROUNDS:
            out.append(f"""mean{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT part, best.entry AS entry, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n
    FROM (SELECT a.part, a.best, c.v, unnest(range(1, len(c.v) + 1)) AS i FROM at{k} a JOIN cut c USING (rid, part)) GROUP BY ALL) GROUP BY part, entry
), book{k + 1} AS (SELECT part, entry, CAST(coalesce(m.v, b.v) AS BIGINT[]) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")  # fmt: skip
    out.append(f"""coded AS (
  SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.off) AS BIGINT) AS error FROM at{ROUNDS} GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM book{ROUNDS})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


SQL = {"op11_vector_codes": _sql()}
