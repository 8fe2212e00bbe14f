"""Embedding near-dedup by collision-counting projections.

Equal vectors are one class. Unit vectors are projected on many random lines. On each, sorted, the window
around a query reaches as far as a near vector's projection strays; a pair that collides in enough windows,
a count calibrated for recall, is verified by its cosine. Labels of many vectors are split in blocks, and
every two blocks of a label meet in one task. Pairs never leave a task: it gives each vector's number of
links and its root among what is linked there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Projections counted; standard deviations of a near pair that the windows reach; the share of near pairs
#: at the threshold whose count must pass; vectors of a block; the seed.
PROJECTIONS, REACH, RECALL, BLOCK, SEED = 20, 2.0, 0.9995, 1500, 7

_LINES: dict[int, np.ndarray] = {}


def lines_of(dims: int) -> np.ndarray:
    """Directions, one a column; the projections of a unit vector spread about 1."""
    if dims not in _LINES:
        _LINES[dims] = np.random.default_rng([SEED, dims]).normal(size=(dims, PROJECTIONS))
    return _LINES[dims]


def least_count() -> int:
    """The largest count that near pairs at the threshold reach with probability RECALL."""
    p, total = math.erf(REACH / math.sqrt(2)), 0.0
    for k in range(PROJECTIONS, -1, -1):
        total += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if total >= RECALL:
            return k
    return 0


def placed(rows: DataFrame) -> DataFrame:
    """(rid, vec_id, label, dims, a, b, vector): the unit vector and a 128-bit name for it; null for vectors that link with nothing."""
    schema = pa.schema([
        ("rid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()),
        ("a", pa.int64()), ("b", pa.int64()), ("vector", pa.list_(pa.float64())),
    ])

    def run(batches):
        for batch in batches:
            found = []
            for label, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found.append((len(x) if x is not None else None, None, None, None))
                if label is None or not x or None in x:
                    continue
                v = np.array(x, np.float64)
                top = np.abs(v).max()
                if not np.isfinite(top) or top == 0:
                    continue
                v /= top
                v /= np.sqrt(v @ v)
                v += 0.0  # -0.0 is 0.0
                name = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                found[-1] = (len(v), int(name[0]), int(name[1]), v)
            yield common.batch_of(schema, *(batch.column(i) for i in range(3)), *zip(*found, strict=True))

    return common.mapped(rows, run, "rid long, vec_id long, label string, dims int, a long, b long, vector array<double>")


def meet(vectors: DataFrame) -> DataFrame:
    """Each vector once for every block of its label that its own one meets: the two blocks i and j, block its own."""
    keys = ["label", "dims"]
    sizes = common.written(vectors.groupBy(*keys).agg(F.count("*").alias("n")), "embedding-labels")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = common.join_hot(vectors, sizes, keys, "n", total)
    at = at.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    b = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(b, k).alias("i"), F.greatest(b, k).alias("j")))
    return at.select("rid", "size", *keys, "vector", "block", F.explode(pairs).alias("met")).select("rid", "size", *keys, "vector", "block", "met.*")


def near_in(group: pa.Table, threshold: float, window: float, least: int, schema: pa.Schema) -> pa.Table:
    """Each vector's links between two blocks, and its root there."""
    rid, size, block = (group.column(x).to_numpy() for x in ("rid", "size", "block"))
    i, j = (group.column(x)[0].as_py() for x in ("i", "j"))
    vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    spots = vectors @ lines_of(vectors.shape[1])
    ranks, lows, widths = [], [], []
    for m in range(PROJECTIONS):  # in the order of each projection, the window around a query is a range of ranks
        order = np.argsort(spots[two, m], kind="stable")
        spot, rank = spots[two, m][order], np.empty(len(two), np.int32)
        rank[order] = np.arange(len(two))
        low = np.searchsorted(spot, spots[one, m] - window)
        ranks.append(rank)
        lows.append(low.astype(np.int32))
        widths.append((np.searchsorted(spot, spots[one, m] + window, side="right") - low).astype(np.uint32))
    left, right = [], []
    for k in range(0, len(one), 256):
        ask = slice(k, k + 256)
        count = np.zeros((len(one[ask]), len(two)), np.int8)
        for rank, low, width in zip(ranks, lows, widths, strict=True):
            count += (rank[None, :] - low[ask, None]).view(np.uint32) < width[ask, None]
        a, b = np.nonzero(count >= least)
        a, b = one[ask][a], two[b]
        if i == j:
            once = a < b
            a, b = a[once], b[once]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
        left.append(a[near])
        right.append(b[near])
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
    np.add.at(links, a, size[b])
    np.add.at(links, b, size[a])
    while len(a):  # the least number spreads along the links, by halving paths
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    found = links > 0
    return pa.table([pa.array(rid[found]), pa.array(links[found]), pa.array(rid[root[found]])], schema=schema)


def link(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label) n_links, component_id and kept.

    Only rows of one label, whatever its type, and as many dimensions are compared. Null labels, and vectors
    that are null, empty, zero or hold null or non-finite components, link with nothing. Equal vectors link
    with each other. Rows that repeat a vec_id are vectors of their own; of those that carry the component's
    smallest id each is kept. A null vec_id takes part, but names no component unless it is alone there, and
    isn't kept. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding"))
    near = math.sqrt(2 - 2 * threshold)
    window, least = REACH * near, least_count()
    rows = common.written(placed(rows), "embedding-rows")
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        return near_in(group, threshold, window, least, schema)

    key = ["label", "dims", "a", "b"]
    named = rows.where("a IS NOT NULL")
    classes = named.groupBy(*key).agg(F.min("rid").alias("rid"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = common.written(classes, "embedding-classes")
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    heads = classes.select("rid", "size")
    heads = named.select("rid", "label", "dims", "vector").join(F.broadcast(heads) if n_classes <= common.BROADCAST_IDS else heads, "rid")
    met = meet(heads).groupBy("label", "dims", "i", "j").applyInArrow(run, "rid long, links long, root long")
    found = common.written(met, "embedding-links")
    roots = common.components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), "embedding-components")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left")
    known = common.written(known.withColumn("component", F.coalesce("component", "rid")), "embedding-known")
    least_id = common.written(known.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id")), "embedding-ids")
    told = common.join_hot(known, least_id, ["component"], "n", n_classes)
    told = common.written(told.select(*key, "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "embedding-told")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    linked = common.join_hot(named.select("vec_id", *key), told, key, "size", n_rows).select("vec_id", "n_links", "component_id", kept)
    alone = rows.where("a IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "embeddings"))
