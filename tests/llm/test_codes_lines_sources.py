"""Vector codes, line dedup and source divergence against plain versions of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import documents

from assayer.llm import cuckoo, line_dedup, source_divergence, vector_codes

# vector codes


def vectors(spark, rows, label="int"):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], f"vec_id long, embedding array<float>, label {label}, q string, code string")


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    d = width // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]))]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (off(x, books[p][e]), e))
    for _ in range(rounds):
        got = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                got[p, best(p, x)].append(x)
        for (p, e), xs in got.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    told = []
    for i, v, label in kept:
        at = [best(p, x) for p, x in enumerate(cut(v))]
        told.append((i, "".join(f"{e:02x}" for e in at), sum(off(x, books[p][at[p]]) for p, x in enumerate(cut(v))), label))
    sums = Counter()
    for _, _, e, label in told:
        sums[label] += e
    return Counter((i, c, e, sums[label], digest) for i, c, e, label in told)


def told(df):
    return Counter(tuple(r) for r in df.collect())


def test_codes_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(7, rows[7][1], 1), (200, None, 1), (201, [None] * 32, 1), (202, [math.nan] * 32, 1), (203, [math.inf] * 32, 2), (204, [], 2), (205, [1.0] * 5, None)]
    rows += [(None, [0.5] * 32, 1), (300, [-1e-30] * 32, 2), (301, [3e6] * 31 + [-3e6], 2)] + [(400 + k, rows[0][1], 1) for k in range(5)]
    rng.shuffle(rows)
    got = told(vector_codes.compress(vectors(spark, rows).repartition(5), 16, 20, 2))
    assert got == plain_codes(rows, 16, 20, 2)


def test_codes_of_large_components_few_rows_and_labels_of_text(spark):
    rows = [(1, [1e9, -1e9, 3.0], "a"), (2, [2e9, 5.0, 1.0], ""), (3, [1.5e9, 0.0, 0.0], None), (4, [1.5e9, 0.0, 0.0], "")]
    assert told(vector_codes.compress(vectors(spark, rows, "string"), 2, 64, 3)) == plain_codes(rows, 2, 64, 3)
    assert vector_codes.compress(vectors(spark, []), 16).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)]), 16).collect() == []
    only_empty = told(vector_codes.compress(vectors(spark, [(1, [], 1), (2, [], 1)]), 16))
    assert {k[:3] for k in only_empty} == {(1, "00" * 16, 0), (2, "00" * 16, 0)}
    with pytest.raises(Exception, match="beyond 2"):
        vector_codes.compress(vectors(spark, [(1, [1e30], 1)]), 1).collect()


def test_nearest_takes_the_first_of_equals_in_both_arithmetics():
    books = np.array([[[0], [2], [2]]], object)
    x = np.array([[1], [2], [5]], np.int64)
    for rows in (x, x.astype(object)):
        at, off = vector_codes.nearest(rows, books)
        assert at[:, 0].tolist() == [0, 1, 1] and off[:, 0].tolist() == [1, 0, 9]


# line dedup


def plain_lines(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add((i is None, i))
    told = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == (i is None, i)]
        told.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(told)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(9)
    common = ["Accept all cookies now", "  ACCEPT all cookies NOW\t", "ÉCOLE des métiers", "école des métiers", "short", "Subscribe to us\r", "0123456789", "123456789"]
    rows = []
    for k in range(80):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(200)} of some text" for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(60) if k % 3 else 100 + k, "\n".join(lines)))
    rows += [(None, "Accept all cookies now\nonly without id here"), (None, "only without id here"), (500, None), (501, ""), (502, "\n"), (503, "x" * 200_000 + "\n" + "y " * 50_000), (504, "x" * 200_000)]
    rows += [(505, "\n".join(f"many lines {k % 700}" for k in range(20_000))), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("loads", [1, 2, 5])
def test_lines_equal_plain_ones(spark, lined, loads):
    assert told(line_dedup.dedup(documents(spark, lined), loads=loads)) == plain_lines(lined)


def test_lines_of_no_documents(spark):
    assert line_dedup.dedup(documents(spark, [])).collect() == []


def fingerprints(index):
    return {r.shard: Counter(np.frombuffer(r.slots, np.uint16).tolist()) - Counter({0: 10**9}) for r in index.filters.collect() if any(r.slots)}


def test_deleting_documents_takes_their_lines_back(spark, lined):
    rows = line_dedup.named(documents(spark, lined))
    refs = lambda df: line_dedup.common.written(line_dedup.references(df, 10), "test-references")
    first, second = rows.where("doc_id % 3 = 0 OR doc_id IS NULL"), rows.where("doc_id % 3 <> 0")
    alone = line_dedup.LineIndex.empty(spark, shards=8).insert(refs(first))
    back = alone.insert(refs(second)).delete(second.select("doc_id"))
    both = alone.insert(refs(second))
    assert told(line_dedup.kept_lines(rows, both)) == plain_lines(lined)
    assert told(line_dedup.kept_lines(first, back)) == told(line_dedup.kept_lines(first, alone)) == plain_lines([r for r in lined if r[0] is None or r[0] % 3 == 0])
    assert Counter(tuple(r) for r in back.counts().collect()) == Counter(tuple(r) for r in alone.counts().collect())
    assert fingerprints(back) == fingerprints(alone)
    again = back.insert(refs(second))
    assert told(line_dedup.kept_lines(rows, again)) == plain_lines(lined)


def test_cuckoo_filter_grows_and_forgets():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 30_000))
    chain = cuckoo.insert([], a[:1000], b[:1000])
    for k in range(1000, 20_000, 1900):  # far beyond what the first table holds
        chain = cuckoo.insert(chain, a[k : k + 1900], b[k : k + 1900])
    assert len(chain) > 1 and cuckoo.contains(chain, a[:20_000], b[:20_000]).all()
    assert sum(int((t > 0).sum()) for t in chain) == 20_000
    assert cuckoo.contains(chain, a[20_000:], b[20_000:]).mean() < 0.002
    chain = cuckoo.remove(chain, a[:15_000], b[:15_000])
    assert cuckoo.contains(chain, a[15_000:20_000], b[15_000:20_000]).all() and sum(int((t > 0).sum()) for t in chain) == 5_000
    assert cuckoo.remove(cuckoo.insert([], a[:5], b[:5]), a[:5], b[:5]) == []
    with pytest.raises(ValueError):
        cuckoo.remove([], a[:1], b[:1])


# source divergence


def plain_audit(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
        sources[lang].add(source)
    told = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: count[lang, s] for s in names} | {None: sum((count[lang, s] for s in names), Counter())}
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            for part, found in (
                ("pair", {x: sum(f(p[s][t], p[x][t]) for t in kept) for x in names if x != s}),
                ("term", {t: f(p[s][t], p[None][t]) for t in kept if of[s][t] and p[s][t] > p[None][t]}),
            ):
                order = sorted(found, key=lambda x: (-found[x], x.encode()))
                told += [(lang, s, part, x, found[x], k) for k, x in enumerate(order, 1) if part == "pair" or k <= top]
    return Counter(told)


def sourced(spark, rows):
    return spark.createDataFrame([(k, *r, "x", "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, gid string")


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(4)
    words = [f"{c}{d}" for c in "abcdefghijé日" for d in "KLMNOPQRSTÜ"] + ["ÀB", "x" * 5000]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(60))) + "-a_b c1d don't", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "Ä"])) for _ in range(150)]
    rows += [(None, "en", "void"), ("", "en", "void"), ("once upon", "xx", "one"), ("other", "xx", "two"), ("word " * 30_000, "en", "s1"), rows[0], rows[0]]
    return rows


def test_audit_equals_the_plain_one(spark, audited):
    assert told(source_divergence.audit(sourced(spark, audited).repartition(4))) == plain_audit(audited)
    assert told(source_divergence.audit(sourced(spark, audited), 1, 5)) == plain_audit(audited, 1, 5)


def test_audit_hands_terms_on_before_they_are_all_there(spark, audited, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 3)
    assert told(source_divergence.counted(sourced(spark, audited[:40])).groupBy("lang", "source", "term").sum("count", "docs")).total() > 0
    assert told(source_divergence.audit(sourced(spark, audited))) == plain_audit(audited)


def test_audit_of_nothing(spark):
    assert source_divergence.audit(sourced(spark, [])).collect() == []
    assert told(source_divergence.audit(sourced(spark, [(None, None, None), (None, None, "b")]))) == plain_audit([(None, None, None), (None, None, "b")])
