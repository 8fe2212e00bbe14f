"""N-gram Jaccard self-join with set-relation skipping, exact.

Equal sets are one class. A class's shingles are ordered by hash, the commonest last; its prefix, the part
of which two sets of enough similarity must share one, goes to the index, lists of which hold each set's
size and the shingle's position in it. Two relations between sets are used to skip work:

Lists of a few sets give the pairs of sets next to each other in size, and later, of what these links
haven't tied together, all. Of longer ones:

Index level: a list is cut into blocks of like size and position. Blocks are compared by their bounds
before any of their members are; a pair of blocks whose positions leave too few shingles is skipped.

Answer level: each block's leader is compared with the others of its list first. A set that links with a
leader follows it, and its answers are derived from the leader's: what it shares with a third set is at
most what the leader shares with that set and what the two differ by. So lists are joined by leaders, and
only where a leader's answer is so near to the threshold that the differences could matter are followers
compared themselves. What links have tied together already is skipped as well.

Before whole sets are compared, parity bits of each, 512 or as many as it has shingles, bound what two share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, wordhash

#: Shingles of a task that are counted together, how often one must occur there to count as common, and
#: how many of the commonest are put last (16 bytes each when broadcast). They set the order of shingles
#: alone: any order gives all links.
BLOCK, COMMON_HERE, COMMONEST = 2_000_000, 8, 200_000
#: Sets of a list whose pairs are all asked for at once; longer lists go by leaders and blocks.
SHORT = 24
#: Turns in which each block's leader is compared with the rest of its list; in the last the short lists' pairs join them.
LEADER_TURNS = 2
#: Sizes of a block differ by less than this factor, positions (from 1) by less than the other.
SIZE_STEP, POSITION_STEP = 1.25, 2.0
#: Parity bits of a set, at least: twice this number; and bits of the coarser parity that goes along in blocks.
PARITY, COARSE = 256, 256
#: Ids that are broadcast when texts are fetched, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased in ASCII."""
    return [np.unique(wordhash.shingles(wordhash.hashes(x.encode("utf-8", "surrogatepass").lower().split()), size)) for x in texts]


def set_id(shingles: np.ndarray, clashing: frozenset = frozenset()) -> tuple[int, int]:
    """A set's number, and a second hash of it that takes its place where two sets have one number."""
    one, two = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
    return (two if one in clashing else one), two


def parity(shingles: np.ndarray) -> bytes:
    """For equal parts of all hashes, as many as the set is large, if the set holds an odd number of them: a bit each."""
    power = max(PARITY, len(shingles) - 1).bit_length()
    odd = np.bincount((shingles >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def coarse(bits: bytes) -> list[int]:
    """The parity bits folded to COARSE of them, as numbers of 64 bits."""
    folded = np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(COARSE, -1), axis=1)
    return np.frombuffer(np.packbits(folded).tobytes(), np.int64).tolist()


def differ(x: bytes, y: bytes) -> int:
    """Shingles that only one of two sets has, at least; the finer bits are folded to the coarser."""
    x, y = (np.unpackbits(np.frombuffer(b, np.uint8)) for b in sorted((x, y), key=len))
    return int((x ^ np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())


def read_sets(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, proof, n, bits, coarse) of each row, and how often common shingles occur in a task's distinct sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("proof", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("coarse", pa.list_(pa.int64())), ("shingle", pa.int64())])

    def counted(block: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(block), return_counts=True)
        value, n = value[n >= COMMON_HERE].view(np.int64), n[n >= COMMON_HERE]
        none = pa.nulls(len(value), pa.int64())
        return common.batch_of(schema, none, none, none, n, pa.nulls(len(value), pa.binary()), pa.nulls(len(value), pa.list_(pa.int64())), value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, block, held = set(), [], 0
        for batch in batches:
            rows = []
            for found in shingle_sets(common.texts_of(batch), size):
                if not len(found):
                    rows.append((None, None, 0, None, None))
                    continue
                rows.append((*set_id(found), len(found), bits := parity(found), coarse(bits)))
                if rows[-1][0] not in seen:
                    seen.add(rows[-1][0])
                    block.append(found)
                    held += len(found)
                if held >= BLOCK:
                    yield counted(block)
                    block, held = [], 0
            yield common.batch_of(schema, batch.column(0), *zip(*rows, strict=True), pa.nulls(len(rows), pa.int64()))
        if block:
            yield counted(block)

    both = common.written(common.mapped(docs, run, "doc_id long, sid long, proof long, n long, bits binary, coarse array<long>, shingle long"), "jaccard-sets")
    return both.where("shingle IS NULL").drop("shingle"), both.where("shingle IS NOT NULL").select("shingle", "n")


def prefix_length(n, threshold: int):
    """How many of a set's n ordered shingles must hold one that any set of enough similarity shares."""
    return n - -(-n * threshold // 100) + 1


def prefixes(docs: DataFrame, size: int, threshold: int, last: np.ndarray, clashing: frozenset) -> DataFrame:
    """(shingle, sid, n, pos, frequent): each distinct set's prefix, once for each task that reads it. last: the commonest, in order."""
    schema = pa.schema([("shingle", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("frequent", pa.bool_())])
    by_value = np.argsort(last)
    held = docs.sparkSession.sparkContext.broadcast((last[by_value], by_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (value, place), seen = held.value, set()
        for batch in batches:
            rows = []
            for found in shingle_sets(common.texts_of(batch), size):
                if not len(found) or (sid := set_id(found, clashing)[0]) in seen:
                    continue
                seen.add(sid)
                rest = len(found)
                if len(value):
                    at = np.minimum(np.searchsorted(value, found), len(value) - 1)
                    is_last = value[at] == found
                    tail = found[is_last][np.argsort(place[at[is_last]])]
                    rest -= len(tail)
                    found = np.concatenate([found[~is_last], tail])
                rows.append((sid, len(found), rest, found[: prefix_length(len(found), threshold)].view(np.int64)))
            if rows:
                length = np.array([len(x) for *_, x in rows])
                sid, n, rest = (np.repeat(np.array([r[k] for r in rows]), length) for k in range(3))
                pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                yield common.batch_of(schema, np.concatenate([x for *_, x in rows]), sid, n.astype(np.int32), pos.astype(np.int32), pos >= rest)

    return common.mapped(docs, run, "shingle long, sid long, n int, pos int, frequent boolean")


def shared_lists(index: DataFrame) -> DataFrame:
    """(shingle, frequent, sets array<struct<sid, n, pos>>) of the lists that hold two sets or more, each set once.

    Lists of up to SHORT sets are one row; of longer ones, and of the commonest shingles, which aren't asked
    how long theirs are, each set is a row. No other shingle occurs as often as those.
    """
    part = F.when(F.col("frequent"), F.pmod("sid", F.lit(256))).otherwise(0)
    rows = index.withColumn("part", part)
    of_list, by_set = Window.partitionBy("shingle", "part"), Window.partitionBy("shingle", "part").orderBy("sid")
    rows = rows.withColumn("before", F.lag("sid").over(by_set)).where("before IS NULL OR before <> sid")
    rows = rows.withColumn("length", F.count("*").over(of_list)).where("frequent OR length > 1")
    alone = F.when(F.col("frequent") | (F.col("length") > SHORT), F.col("sid"))
    return rows.groupBy("shingle", "frequent", "part", alone.alias("alone")).agg(F.collect_list(F.struct("sid", "n", "pos")).alias("sets")).select("shingle", "frequent", "sets")


def short_pairs(index: DataFrame, threshold: int, most: int) -> DataFrame:
    """(a, b): of each short list, by size, each set with so many of the next ones, if sizes and positions let them match."""

    def meets(x: Column, y: Column) -> Column:
        small, large, rest = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"]), F.least(x["n"] - 1 - x["pos"], y["n"] - 1 - y["pos"])
        return (100 * small >= threshold * large) & ((100 + threshold) * (1 + rest) >= need(threshold, x["n"], y["n"]))

    pair = lambda x, y: F.struct(F.least(x["sid"], y["sid"]).alias("a"), F.greatest(x["sid"], y["sid"]).alias("b"))
    after = lambda x, i: F.transform(F.filter(F.slice("sets", i + 2, F.lit(most)), lambda y: meets(x, y)), lambda y: pair(x, y))
    lists = index.where("size(sets) > 1").select(F.sort_array(F.transform("sets", lambda x: F.struct(x["n"].alias("n"), x["sid"].alias("sid"), x["pos"].alias("pos")))).alias("sets"))
    return lists.select(F.explode(F.flatten(F.transform("sets", after))).alias("p")).select("p.*").distinct()


def need(threshold: int, n: Column, m: Column) -> Column:
    """100 + threshold times what sets of these sizes must share."""
    return threshold * (n + m)


def may_match(threshold: int) -> str:
    """If sets a and b, which meet at these positions first, can be similar enough."""
    sizes = f"100 * least(a_n, b_n) >= {threshold} * greatest(a_n, b_n)"
    return f"{sizes} AND {100 + threshold} * (1 + least(a_n - 1 - a_pos, b_n - 1 - b_pos)) >= {threshold} * (a_n + b_n)"


def size_cell(n: Column) -> Column:
    return F.floor(F.log(n) / np.log(SIZE_STEP)).cast("int")


def sides(rows: DataFrame, *columns: str, by: tuple[str, ...] = ("shingle",)) -> list[DataFrame]:
    """rows as side a and as side b of a join on by."""
    return [rows.select(*by, *[F.col(c).alias(f"{x}_{c}") for c in columns]) for x in "ab"]


def leader_pairs(lists: DataFrame, threshold: int, turn: int) -> DataFrame:
    """(a, b): each block's leader with the sets of its list of like size that aren't tied to it yet."""
    blocks = lists.withColumn("cell", size_cell(F.col("n")))
    of = F.struct("sid", "n", "pos", "component")
    leader = blocks.groupBy("shingle", "cell").agg(F.min_by(of, F.struct(F.xxhash64("sid", F.lit(turn)), "sid")).alias("b"))
    near = leader.select("shingle", "b", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    met = blocks.join(near, ["shingle", "cell"]).where("component <> b.component")
    met = met.selectExpr("sid AS a", "b.sid AS b", "n AS a_n", "b.n AS b_n", "pos AS a_pos", "b.pos AS b_pos").where(may_match(threshold))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_pairs(lists: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """(a, b, slack, a_least, b_least): heads that some list holds, themselves or by followers, in blocks whose bounds let them match, and that aren't tied.

    heads (head, own, coarse, far, least) go along, so that a pair is there only if the coarse parity bits let its groups match.
    """
    rest = F.col("n") - 1 - F.col("pos")
    cells = lists.withColumn("cell", size_cell(F.col("n"))).withColumn("part", F.floor(F.log(F.col("pos") + 1) / np.log(POSITION_STEP)).cast("int"))
    member = cells.groupBy("shingle", "cell", "part", "head").agg(F.min("component").alias("component"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(rest).alias("rest"))
    member = common.written(member.join(heads, "head"), "jaccard-members")
    block = member.groupBy("shingle", "cell", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"), F.min("component").alias("first"), F.max("component").alias("last"))
    sizes = f"100 * a_high >= {threshold} * b_low AND 100 * b_high >= {threshold} * a_low"
    bound = f"{sizes} AND {100 + threshold} * (1 + least(a_rest, b_rest)) >= {threshold} * (a_low + b_low)"
    apart = " + ".join(f"bit_count(a_coarse[{k}] ^ b_coarse[{k}])" for k in range(COARSE // 64))
    share = f"{100 + threshold} * (a_own + b_own + 2 * (a_far + b_far) - ({apart})) >= {2 * threshold} * (a_least + b_least)"
    a, b = sides(block, "cell", "part", "low", "high", "rest", "first", "last")
    met = a.join(b, "shingle").where(f"struct(a_cell, a_part) <= struct(b_cell, b_part) AND {bound} AND NOT (a_first = a_last AND b_first = b_last AND a_first = b_first)")
    met = common.written(met.select("shingle", "a_cell", "a_part", "b_cell", "b_part"), "jaccard-blocks")
    carried = ("cell", "part", "head", "component", "low", "high", "rest", "own", "coarse", "far", "least")
    one, two = (member.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in carried]) for x in "ab")
    pairs = met.join(one, ["shingle", "a_cell", "a_part"]).join(two, ["shingle", "b_cell", "b_part"]).where(f"a_component <> b_component AND {bound} AND {share}")
    first = F.col("a_head") < F.col("b_head")
    turned = lambda c: [F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))]
    (a, b), (a_least, b_least) = turned("head"), turned("least")
    return pairs.select(a.alias("a"), b.alias("b"), (F.col("a_far") + F.col("b_far")).alias("slack"), a_least.alias("a_least"), b_least.alias("b_least")).distinct()


def may_share(classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """(a, b, a_n, b_n) of pairs (a, b, slack, a_least, b_least) whose parity bits let them share, with slack more, what they need."""
    of, schema = classes.select("sid", "n", "bits"), pa.schema([(x, pa.int64()) for x in ("a", "b", "a_n", "b_n")])
    for x in "ab":
        pairs = pairs.join(of.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")), x)
    least = need(threshold, F.coalesce("a_least", "a_n"), F.coalesce("b_least", "b_n")).cast("long")
    most = (F.col("a_n") + F.col("b_n") + 2 * F.col("slack")).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)])
            ok = (100 + threshold) * (batch.column(6).to_numpy() - apart) >= 2 * batch.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays(batch.columns[:4], schema=schema).filter(pa.array(ok))

    return common.mapped(pairs.select("a", "b", "a_n", "b_n", "a_bits", "b_bits", most, least), run, "a long, b long, a_n long, b_n long")


class Sets:
    """Compares whole sets, read anew from the texts of the documents that are asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, threshold: int, clashing: frozenset):
        self.docs, self.classes, self.size, self.threshold, self.clashing = docs, classes, size, threshold, clashing

    def fetch(self, pairs: DataFrame) -> DataFrame:
        """(sid, shingles) of the pairs' sets."""
        size, clashing = self.size, self.clashing
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(self.classes.select("sid", "doc_id"), "sid")
        wanted = common.written(wanted, "jaccard-wanted")
        texts = self.docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("sid", "text")
        schema = pa.schema([("sid", pa.int64()), ("shingles", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = {}
                for sid, x in zip(batch.column(0).to_pylist(), shingle_sets(common.texts_of(batch), size), strict=True):
                    if len(x) and set_id(x, clashing)[0] == sid:  # where a doc_id repeats, only the rows with that very set count
                        kept[sid] = x.tobytes()
                if kept:
                    yield common.batch_of(schema, *zip(*kept.items(), strict=True))

        return common.written(common.mapped(texts, run, "sid long, shingles binary").dropDuplicates(["sid"]), "jaccard-shingles")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, a_n, b_n, shared, linked) of pairs (a, b, slack, a_least, b_least) that may share what they need."""
        pairs = common.written(may_share(self.classes, pairs, self.threshold), "jaccard-pairs")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_n", pa.int64()), ("b_n", pa.int64()), ("shared", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared = []
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                    shared.append(int((both[1:] == both[:-1]).sum()))
                yield common.batch_of(schema, *(batch.column(k) for k in range(4)), shared)

        if pairs.isEmpty():
            return pairs.withColumns({"shared": F.lit(0).cast("long"), "linked": F.lit(False)})
        sets = self.fetch(pairs)
        one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
        two = one.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
        found = common.mapped(two.select("a", "b", "a_n", "b_n", "x", "y"), run, "a long, b long, a_n long, b_n long, shared long")
        linked = (100 + self.threshold) * F.col("shared") >= need(self.threshold, F.col("a_n"), F.col("b_n"))
        found = common.written(found.withColumn("linked", linked), "jaccard-compared")
        common.discard(sets)
        return found


def plain(pairs: DataFrame) -> DataFrame:
    """Pairs that are compared for themselves alone."""
    return pairs.withColumns({"slack": F.lit(0), "a_least": F.lit(None).cast("long"), "b_least": F.lit(None).cast("long")})


def tied(root: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, component) with the links added."""
    if root is None or not links.isEmpty():
        known = links.select("a", "b")
        known = known if root is None else known.unionByName(root.select(F.col("node").alias("a"), F.col("component").alias("b")))
        root = common.written(common.components(known, "jaccard-components"), "jaccard-roots")
    return root


def with_component(rows: DataFrame, root: DataFrame, sid: str, name: str) -> DataFrame:
    found = rows.join(root.select(F.col("node").alias(sid), F.col("component").alias(name)), sid, "left")
    return found.withColumn(name, F.coalesce(name, sid))


def untied(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    found = with_component(with_component(pairs, root, "a", "_a"), root, "b", "_b")
    return found.where("_a <> _b").drop("_a", "_b")


def open_lists(lists: DataFrame, root: DataFrame) -> DataFrame:
    """The lists that hold sets of more than one component.

    The commonest shingles, COMMONEST at most, are broadcast, so that no task gets all rows of one; the others,
    which are in no list as long as theirs, are joined by a shuffle. Either join hands on the rows asked for alone.
    """
    rows = common.written(with_component(lists, root, "sid", "component"), "jaccard-told")
    mixed = rows.groupBy("shingle", "frequent").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = common.written(mixed.select("shingle", "frequent"), "jaccard-mixed")
    hot, cold = (rows.where(part).join(named, "shingle", "left_semi") for part, named in (("frequent", F.broadcast(mixed.where("frequent"))), ("NOT frequent", mixed.where("NOT frequent"))))
    return common.written(hot.unionByName(cold).drop("frequent"), "jaccard-open")


def followers(links: DataFrame) -> DataFrame:
    """(sid, head, d): sets that follow a head that they link with, and how many shingles they have that it hasn't.

    Heads come first, by a hash, among all that they link with; of several heads the likest is followed.
    """
    both = links.select("a", "b", "a_n", "shared").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), "shared"))
    rank = lambda c: F.struct(F.xxhash64(c), c)
    heads = both.groupBy("a").agg(F.min(rank("b")).alias("first")).where(F.col("first") > F.struct(F.xxhash64("a").alias("col1"), F.col("a").alias("b")))
    heads = common.written(heads.select(F.col("a").alias("b")), "jaccard-heads")
    return both.join(heads, "b").groupBy(F.col("a").alias("sid")).agg(F.max_by(F.struct(F.col("b").alias("head"), (F.col("a_n") - F.col("shared")).alias("d")), F.struct("shared", "b")).alias("f")).select("sid", "f.*")


def link(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """Per row of docs doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    A document with fewer than size words has one shingle, all its words; without words or with a null
    text it has none and its own doc_id. Rows with a null doc_id link with nothing, their component_id is
    null; rows that repeat a doc_id are each judged by their text. Very long texts are read whole. An empty
    table gives no rows; other columns of docs are ignored. Shingles are told apart by 64-bit hashes, which
    two shingles of the same two sets share by a chance of their number squared in 2^64; sets by 128 bits.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows, frequent = read_sets(docs, size)
    proofs = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high")
    clashing = frozenset(r.sid for r in proofs.select("sid").collect())  # of N sets about N squared in 2^65
    if clashing:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(*clashing), F.col("proof")).otherwise(F.col("sid")))
    named = docs.where("doc_id IS NOT NULL")
    classes = rows.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("coarse").alias("coarse"), F.count("*").alias("copies"))
    classes = common.written(classes, "jaccard-classes")

    ranked = frequent.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMONEST).select("shingle").toArrow()
    commonest = ranked.column(0).to_numpy().view(np.uint64)[::-1]
    index = prefixes(named.select("text"), size, threshold, commonest, clashing)
    index = common.written(shared_lists(index), "jaccard-index")
    lists = index.where("size(sets) = 1").select("shingle", "frequent", F.col("sets")[0].alias("s")).select("shingle", "frequent", "s.*")

    sets, links = Sets(named, classes, size, threshold, clashing), []
    links.append(sets.compare(plain(short_pairs(index, threshold, 1))).where("linked"))
    root = tied(None, links[-1])
    for turn in range(LEADER_TURNS):
        asked = leader_pairs(open_lists(lists, root), threshold, turn)
        if turn == LEADER_TURNS - 1:
            asked = asked.unionByName(untied(short_pairs(index, threshold, SHORT), root)).distinct()
        links.append(sets.compare(plain(common.written(asked, "jaccard-leaders"))).where("linked"))
        root = tied(root, links[-1])

    # long lists by their heads: what is left to be found is between sets of different components
    follow = common.written(followers(reduce(DataFrame.unionByName, links)), "jaccard-followers")
    of = follow.select("sid", "head", "d")
    left = open_lists(lists, root).join(of, "sid", "left").withColumn("head", F.coalesce("head", "sid"))
    own = classes.select("sid", "n")
    group = follow.join(own, "sid").groupBy("head").agg(F.max("d").alias("far"), F.min("n").alias("least"))
    heads = classes.select(F.col("sid").alias("head"), F.col("n").alias("own"), "coarse").join(group, "head", "left")
    heads = heads.withColumn("far", F.coalesce("far", F.lit(0).cast("long"))).withColumn("least", F.least("least", "own"))
    asked = common.written(block_pairs(left, heads, threshold), "jaccard-asked")
    compared = sets.compare(asked)
    root = tied(root, compared.where("linked"))

    # followers of heads that miss the threshold by less than the differences
    enough = lambda more, n, m: (100 + threshold) * (F.col("shared") + more) >= need(threshold, n, m)
    near = compared.where("NOT linked").join(asked, ["a", "b"]).where(enough(F.col("slack"), F.col("a_least"), F.col("b_least")))
    near = common.written(untied(near.where("slack > 0").select("a", "b", "a_n", "b_n", "shared"), root), "jaccard-near")
    if not near.isEmpty():
        sizes = follow.join(own, "sid")
        spokes = []
        for x, y in ("ab", "ba"):
            spoke = near.join(sizes.withColumnRenamed("head", x), x).where(enough(F.col("d"), F.col("n"), F.col(f"{y}_n")))
            spokes.append(spoke.select(F.least("sid", y).alias("a"), F.greatest("sid", y).alias("b")))
        root = tied(root, sets.compare(plain(spokes[0].unionByName(spokes[1]).distinct())).where("linked"))
        near = untied(near, root)
        for x in "ab":
            near = near.join(sizes.select(F.col("head").alias(x), F.col("sid").alias(f"{x}_sid"), F.col("d").alias(f"{x}_d"), F.col("n").alias(f"{x}_size")), x)
        met = near.where(enough(F.col("a_d") + F.col("b_d"), F.col("a_size"), F.col("b_size")))
        met = untied(met.select(F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b")).distinct(), root)
        root = tied(root, sets.compare(plain(met)).where("linked"))

    n_rows = rows.count()
    least = root.withColumnRenamed("node", "sid").join(classes, "sid").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_root = root.join(common.written(least, "jaccard-least"), "component").select(F.col("node").alias("sid"), "component_id")
    ids = classes.join(of_root, "sid", "left").select("sid", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = common.join_hot(rows.where("sid IS NOT NULL"), common.written(ids, "jaccard-ids"), ["sid"], "copies", n_rows, "left")
    joined = joined.select("doc_id", "n", "component_id").unionByName(rows.where("sid IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))
