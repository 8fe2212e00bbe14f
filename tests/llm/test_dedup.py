"""Exact, Jaccard, substring and embedding dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from assayer.llm import common, embedding_dedup, exact_dedup, ngram_jaccard, recompress, substring_dedup, wordhash
from conftest_llm import documents


class Links:
    def __init__(self):
        self.up = {}

    def of(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng, links = random.Random(1), Links()
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    for a, b in pairs:
        links.tie(a, b)
    found = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: links.of(x) for a, b in pairs if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(spark, corpus, digest_bytes):
    found = exact_dedup.dedup(documents(spark, corpus), digest_bytes).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault("".join(c for c in t or "" if c not in common.WHITE), []).append((-len(t or ""), i))
    text = dict(corpus)
    assert len(found) == len(corpus)
    for r in found:
        norm = "".join(c for c in text[r.doc_id] or "" if c not in common.WHITE)
        assert (r.keep_id, r.group_size) == (min(groups[norm])[1], len(groups[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    assert sum(r.kept for r in found) == len(groups)


def test_exact_by_levels(spark, corpus, monkeypatch):
    """A run for each partition, merged two by two; filters that are broadcast, and that are dealt by bucket."""
    wanted = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(documents(spark, corpus)).collect())
    monkeypatch.setattr(exact_dedup, "RUN_PARTS", 1)
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    docs = common.written(documents(spark, corpus, 9), "nine")
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(docs.repartition(9)).collect()) == wanted
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_without_ids(spark):
    found = exact_dedup.dedup(documents(spark, [(None, "a b"), (3, "ab"), (None, None), (None, "")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in found if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()) == [(-1, None, 2, True), (3, None, 2, False)]
    assert sum(r.kept for r in found) == 2


def jaccard(corpus):
    sets, links = {}, Links()
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.tie(a, b)
    return {i: (len(x), links.of(i)) for i, x in sets.items()}


@pytest.mark.parametrize("commonest", [500_000, 0])
def test_jaccard(spark, corpus, monkeypatch, commonest):
    monkeypatch.setattr(ngram_jaccard, "COMMON_HERE", 2)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", 2)
    monkeypatch.setattr(ngram_jaccard, "SHORT", 24 if commonest else 1)
    if not commonest:
        monkeypatch.setattr(ngram_jaccard, "COMMONEST", 1)
    found = ngram_jaccard.link(documents(spark, corpus)).collect()
    wanted = jaccard(corpus)
    assert len(found) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert len({c for _, c in wanted.values()}) < len(wanted) - 10


def test_jaccard_chains(spark, monkeypatch):
    """Texts that drift: neighbours link, ends don't; and a group whose sets differ in pairs."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 + k, " ".join(words[8 * k : 8 * k + 120])) for k in range(25)]
    base = [f"v{i}" for i in range(90)]
    for k in range(20):
        rows.append((200 + k, " ".join([*base[: 4 * k], f"x{k}", *base[4 * k + 1 :]])))
    rows += [(None, rows[0][1]), (None, None)]
    monkeypatch.setattr(ngram_jaccard, "SHORT", 2)
    found = ngram_jaccard.link(documents(spark, rows)).collect()
    wanted = jaccard([x for x in rows if x[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert [r.component_id for r in found if r.doc_id is None] == [None, None]


def made_by_joins(plan):
    """Rows that the joins of a plan that has run hand on."""
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    if plan.nodeName() == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif plan.nodeName().endswith("QueryStage"):
        below = [plan.plan()]
    return (plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0) + sum(map(made_by_joins, below))


def test_joins_hand_on_open_lists_alone(spark, monkeypatch):
    """Lists whose sets are one component, commonest or not, don't leave a join only to be dropped after it."""
    lists = [(1, True, k) for k in range(40)] + [(2, True, k) for k in range(10, 300)] + [(3, False, k) for k in (1, 350)] + [(4, False, k) for k in range(50, 90)]
    lists = spark.createDataFrame([(*x, 100, 0) for x in lists], "shingle long, frequent boolean, sid long, n int, pos int")
    root = spark.createDataFrame([(k, 0) for k in range(300) if k not in (7, 9)], "node long, component long")
    asked, write = [], ngram_jaccard.common.written

    def written(df, name):
        if name == "jaccard-open":
            asked.append(df)
        return write(df, name)

    monkeypatch.setattr(ngram_jaccard.common, "written", written)
    monkeypatch.setattr(ngram_jaccard.common, "HOT_KEYS", 2)
    found = ngram_jaccard.open_lists(lists, root).collect()
    assert sorted((r.shingle, r.sid, r.component) for r in found) == [(1, k, k if k in (7, 9) else 0) for k in range(40)] + [(3, 1, 0), (3, 350, 350)]
    asked[0].collect()
    assert made_by_joins(asked[0]._jdf.queryExecution().executedPlan()) == len(found)


def trim(corpus, window):
    first, words = {}, {i: (t or "").encode().split() for i, t in corpus}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_substrings(spark, corpus, monkeypatch, few):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", few)
    monkeypatch.setattr(substring_dedup, "GROUP_CHARS", 4000)
    found = substring_dedup.dedup(documents(spark, corpus)).collect()
    assert len(found) == len(corpus)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == trim(corpus, 50)


def test_substrings_of_few_words(spark):
    """Texts over two words: long runs and many repeats inside a text."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "b"], weights=[k % 7 + 1, 1], k=rng.randint(0, 90)))) for i, k in enumerate(range(60))]
    rows += [(100, "a " * 200), (101, "b a " * 80), (102, "a " * 60 + "c"), (None, "a " * 200)]
    found = [r for r in substring_dedup.dedup(documents(spark, rows), 8).collect() if r.doc_id is not None]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == trim([x for x in rows if x[0] is not None], 8)


def test_substrings_where_ids_repeat(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, other = words(60), words(70)
    rows = [(1, " ".join(words(20) + shared + words(20))), (5, " ".join(words(50) + shared + words(50))), (5, " ".join(words(80))), (5, " ".join(words(40))), (5, " ".join(other)), (5, " ".join(other)), (7, " ".join(other)), (7, "x " + " ".join(other))]
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(documents(spark, rows)).collect())
    assert found == [(1, 100, 0), (5, 40, 0), (5, 70, 0), (5, 70, 0), (5, 80, 0), (5, 160, 60), (7, 70, 70), (7, 71, 70)]


def test_symbols_recur_with_what_they_depend_on():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 6, 3000).astype(np.uint64)
    words[2000:2060] = words[500:560]
    words = wordhash.mixed(words)
    first = np.zeros(3000, bool)
    first[[0, 1000, 1990]] = True
    s = recompress.parse(words, first)
    for turn in range(3):
        at = list(zip(s.name.tolist(), s.start.tolist(), s.end.tolist(), s.low.tolist(), s.high.tolist(), strict=True))
        here = {(n, a - 500, b - 500) for n, a, b, low, high in at if low >= 500 and high <= 560}
        there = {(n, a - 2000, b - 2000) for n, a, b, *_ in at}
        assert here <= there and (here or turn)
        if turn < 2:
            s = recompress.pairs(s, np.append(first, False), np.append(first, True), turn + 1)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng, links = np.random.default_rng(9), Links()
    x = rng.normal(size=(400, 16))
    for k in range(60):
        x[100 + k] = x[k % 7] + rng.normal(size=16) * 0.09
    label = [int(i) % 2 for i in range(400)]
    rows = [(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None] * 8, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (None, rows[1][1], label[1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in embedding_dedup.link(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(400, dtype=bool)
    for a, b in zip(*np.nonzero(near), strict=True):
        links.tie(int(a), int(b))
    got = sum(found[i].n_links - (i == 1 or bool(near[1, i])) for i in range(400))
    assert got >= 0.99 * near.sum() and got <= near.sum() and near.sum() > 100
    assert sum(found[i].component_id != links.of(i) for i in range(400)) <= 2
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in range(900, 907))
    assert not found[None].kept
    assert embedding_dedup.link(table.limit(0)).count() == 0


def test_embeddings_of_any_label(spark):
    """Copies are one class whose members link; labels of other types stay what they are; further columns are ignored."""
    rows = [(i, [1.0, float(i % 2)], 1.2 if i < 4 else 1.7, "x", 1) for i in range(8)] + [(8, [2.0, 0.0], 1.2, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double, size string, cells int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(table).collect()}
    assert found == {0: (2, 0, True), 2: (2, 0, False), 8: (2, 0, False), 1: (1, 1, True), 3: (1, 1, False), 4: (1, 4, True), 6: (1, 4, False), 5: (1, 5, True), 7: (1, 5, False)}


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert exact_dedup.dedup(empty).count() == ngram_jaccard.link(empty).count() == substring_dedup.dedup(empty).count() == 0
