"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

One pass turns each whole text into statistics. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; each task sums its rows' part of the normal equations, the parts are summed
by row of the matrix, and the driver solves a system whose size the data don't change. A fold that the
fit doesn't see is summed in bins of raw score, of which pool-adjacent-violators makes the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Random features, the kernel's width in standard deviations for each statistic, the ridge, the seed.
FEATURES, WIDTH, RIDGE, SEED = 160, 1.5, 1.0, 20240607
#: Bins of raw score for the calibration, over [-0.5, 1.5).
BINS = 400

#: Common short words of the languages at hand: running text has them.
STOPWORDS = frozenset(b"the of and to in a is that it for was on with as are de la le les et un une que el los en y der die das und ist nicht von zu den mit".split())
PUNCTUATION = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])
SENTENCE = np.array([chr(c) in ".,;:?'-\"()" for c in range(256)])
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "odd_punctuation", "doubled_punctuation",
    "exclaim", "bars", "white", "line_words", "repeated_lines", "repeated_words", "stopwords", "stops", "high_bytes", "control",
    "top_word", "punctuated_words",
)


def statistics(text: str) -> list[float]:
    """Numbers that say how a text is made, nothing of what it says; all zero for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    code = np.frombuffer(raw, np.uint8)
    count = np.bincount(code, minlength=256)
    n, m = len(raw), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lower = [w.strip(b".,;:!?").lower() for w in words]
    distinct = len(set(lower))
    odd = PUNCTUATION & ~SENTENCE
    doubled = int((PUNCTUATION[code[1:]] & (code[1:] == code[:-1])).sum())
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    return [
        np.log1p(n), np.log1p(m), sum(map(len, words)) / m, count[65:91].sum() / n, count[48:58].sum() / n,
        count[PUNCTUATION].sum() / n, count[odd].sum() / n, doubled / m, count[33] / m, count[124] / m, (count[9:14].sum() + count[32]) / n,
        m / len(lines), 1 - len(set(lines)) / len(lines), 1 - distinct / m, sum(w in STOPWORDS for w in lower) / m,
        (count[46] + count[63]) / m, count[128:].sum() / n, (count[:9].sum() + count[14:32].sum()) / n,
        max(lower.count(w) for w in {lower[0], lower[m // 2], lower[-1]}) / m, float(odd[ends].mean()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield common.batch_of(schema, batch.column(0), [statistics(x) for x in common.texts_of(batch)])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, stats array<double>")


class Basis:
    """Random cosine features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), FEATURES - 1))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("stats"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def normal_equations(train: DataFrame, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """ZᵀZ and Zᵀy, summed in each partition and then by row of the matrix."""
    schema = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = basis(stats_of(batch))
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            part = np.hstack([z.T @ z, (z.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            yield common.batch_of(schema, np.arange(len(total)), list(total))

    def add(group: pa.Table) -> pa.Table:
        column = group.column("sums").combine_chunks()
        sums = column.flatten().to_numpy().reshape(len(column), -1).sum(axis=0)
        return pa.table([group.column("i").slice(0, 1), pa.array([sums], pa.list_(pa.float64()))], schema=schema)

    rows = common.mapped(train.select("stats", "y"), run, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>").collect()
    system = np.zeros((FEATURES, FEATURES + 1))
    for r in rows:
        system[r.i] = r.sums
    return system[:, :-1], system[:, -1]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-decreasing means of y / n, in the order of x, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for i in np.argsort(x):
        blocks.append([y[i], n[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.concatenate([np.full(int(c), a / b) for a, b, c in blocks]) if blocks else np.zeros(0)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(-1))


def bin_of(raw: Column) -> Column:
    return F.least(F.greatest(F.floor((raw + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs its score: how likely labels.quality is 1, and 1 from threshold on.

    Labels count only where crc32 of doc_id mod 5 isn't 0: folds 1 to 3 fit, fold 4 calibrates; null
    labels and doc_ids without a row count nowhere. A null text is empty and is scored by its zero
    statistics. doc_id may be null (never held out) or repeat. Without labels every score is 0.5. An empty
    table gives no rows; other columns are ignored.
    """
    stats = common.written(with_statistics(docs), "quality-stats")
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    known = common.written(stats.join(marks, "doc_id").where(fold(F.col("doc_id")) != 0), "quality-train")
    train, held = known.where(fold(F.col("doc_id")).isin(1, 2, 3)), known.where(fold(F.col("doc_id")) == 4)
    at = [F.col("stats")[i] for i in range(len(STATISTICS))]
    row = train.agg(*[F.avg(x) for x in at], *[F.stddev_pop(x) for x in at], F.avg("y"), F.count("*")).first()
    k, base, n = len(at), row[-2], row[-1]
    mean = np.array([x or 0.0 for x in row[:k]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in row[k : 2 * k]])
    basis, solved = Basis(mean, scale), np.zeros(FEATURES)
    base = 0.5 if base is None else base
    if n:
        a, b = normal_equations(train.withColumn("y", F.col("y") - F.lit(base)), basis)
        solved = np.linalg.solve(a + RIDGE * np.eye(FEATURES), b)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = basis(stats_of(batch)) @ solved + base
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "stats"]
            names = [x for x in batch.schema.names if x != "stats"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found)], names=[*names, "raw"])

    bins = common.mapped(held.select("y", "stats"), raw, "y double, raw double").groupBy(bin_of(F.col("raw")).alias("bin"))
    found = sorted(map(tuple, bins.agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()))
    x, m, y = (np.array(c, float) for c in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
    centre, level = (x + 0.5) / (BINS / 2) - 0.5, isotonic(x, m, y)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in raw(batches):
            value = batch.column(1).to_numpy()
            if len(level):  # a little of the raw score keeps the order within a level
                value = 0.98 * np.interp(value, centre, level) + 0.02 * np.clip(value, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(value, 0.0, 1.0))], names=["doc_id", "score"])

    result = common.mapped(stats, scored, "doc_id long, score double")
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return result.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
