"""Excerpt verification over whole documents, against brute force."""

import random

from assayer.functions import fuzzy, text
from assayer.operators import ground_truth, passages, scoring
from assayer.plans import text_queries


def test_distances_carried_along_a_text():
    rng = random.Random(1)
    for _ in range(300):
        p, t = "".join(rng.choices("ab c", k=rng.randint(1, 9))), "".join(rng.choices("ab cd", k=rng.randint(1, 14)))
        least = [min(len(p) + j - i - 2 * fuzzy.lcs(p, t[i:j]) for i in range(j + 1)) for j in range(1, len(t) + 1)]
        assert fuzzy.end_distances(p, t).tolist() == least, (p, t)


def test_reaches_is_partial():
    rng = random.Random(3)
    for k in range(400):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, n))) for n in (25, 60))
        if k % 2 and a:
            b = b[:20] + "".join(c if rng.random() > 0.08 else "z" for c in a) + b[20:]
        for threshold in (60.0, 75.0, 90.0):
            assert fuzzy.reaches(a, b, threshold) == (fuzzy.partial(a, b) >= threshold), (a, b)


def test_reaches_is_partial_at_the_bound():
    rng = random.Random(4)
    for k in range(120):
        a = "".join(rng.choices("abcdefgh ", k=rng.randint(30, 60)))
        near = "".join("z" if rng.random() < 0.1 else c for c in a)
        b = "".join(rng.choices("abcdefgh ", k=70)) + near + "".join(rng.choices("abcdefgh ", k=k % 50))
        assert fuzzy.reaches(a, b, 90.0) == (fuzzy.partial(a, b) >= 90), (a, b)


def test_excerpt_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 7))) for _ in range(40)]
    make = lambda n: rng.choices(words, k=n)
    texts = [make(14) for _ in range(6)]
    items = [(k, " ".join(p)) for k, p in enumerate(texts)] + [(6, "Óne tWo"), (7, " "), (8, None)]
    docs = []
    for k in range(18):
        p = texts[k % 6][:]
        if k % 3 == 1:
            p[7] = p[7][:-1] + "x"  # near
        if k % 3 == 2:
            p[4:10] = make(6)  # the head stays, the rest is another text
        docs.append((k, " ".join(make(120) + p + make(60)).title()))
    docs += [(100, None), (101, ""), (102, "one"), (103, "here one  TWO stand"), (104, " ".join(texts[0][:2])), (None, items[1][1])]
    tables = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    pairs = passages.excerpt_pairs(*tables)
    found = {(r.doc_id, r.item_id): r.verified for r in scoring.verify_excerpts(pairs, "excerpt", "source").collect()}
    wanted = {}
    for i, d in docs:
        for j, p in items:
            d_, p_ = text.plain(d or ""), text.plain(p or "")
            a, b = d_.split(), p_.split()
            n = min(3, len(a), len(b))
            if n and {tuple(a[k : k + n]) for k in range(len(a) - n + 1)} & {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}:
                wanted[i, j] = p_ in d_ or fuzzy.partial(p_, d_) >= 90
    assert found == wanted
    assert {True, False} == set(found.values()) and sum(found.values()) >= 12
    assert pairs.count() == len(found)
    assert passages.excerpt_pairs(tables[0], tables[1].limit(0)).count() == 0


def test_query_reads_long_documents_and_the_benchmark(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.verified for r in text_queries.excerpt_verification(spark, sf).collect()}
    whole = {(i, j) for i, d in docs.items() for j, p in items.items() if p in d}
    assert whole and whole <= {x for x, v in found.items() if v}
    assert any(len(docs[i]) >= 400 for i, _ in found)


def test_quotations_from_anywhere_in_a_passage(spark):
    words = [f"w{k}" for k in range(30)]
    items = [(1, " ".join(words)), (2, "a short one"), (3, None), (4, ""), (5, "x"), (5, "y " * 9)]
    docs = [
        (1, "before " + "  ".join(words[12:20]) + "\tafter"),  # eight words from the middle
        (2, " ".join(words[:7]) + " other " + " ".join(words[8:15])),  # seven at most
        (3, "this is a short one indeed"), (4, "a short\none"), (5, "a short"), (6, None), (7, ""), (8, "w0"), (9, "it is x"), (9, "nothing"), (None, " ".join(words)), (10, "y " * 8),
    ]
    tables = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    found = {tuple(r) for r in passages.leaked(*tables).collect()}
    assert found == {(1, 1), (None, 1), (3, 2), (4, 2), (9, 5), (10, 5)}
    assert passages.leaked(tables[0].limit(0), tables[1]).count() == passages.leaked(tables[0], tables[1].limit(0)).count() == 0


def taken_in_order(rows, leaks, confidence, logprob, cap):
    kept, full, told = set(), {}, []
    for ordinal, record, value, c, lp in sorted(rows):
        if record in leaks:
            reason = "gt_leak"
        elif record in kept:
            reason = "dup"
        elif confidence and (c is None or c < confidence):
            reason = "low_confidence"
        elif logprob and (lp is None or lp < logprob):
            reason = "low_logprob"
        elif cap and full.get(value, 0) >= cap:
            reason = "over_cap"
        else:
            reason, full[value] = "kept", full.get(value, 0) + 1
            kept.add(record)
        told.append((ordinal, reason))
    return told


def test_training_rows_are_those_taken_in_order(spark):
    rng = random.Random(2)
    for cap, records in ((0, 40), (3, 40), (2, 15)):
        rows = [(k, rng.randrange(records), rng.choice("abcde") if k % 9 else None, rng.choice([None, 0.2, 0.6, 0.9]), rng.choice([None, 0.5, 0.9, 0.9])) for k in range(120)]
        frame = spark.createDataFrame(rows, "ordinal long, record_id long, value string, confidence double, logprob double")
        truth = spark.createDataFrame([(3,), (3,), (7,)], "record_id long")
        for bounds in ((0.0, 0.0), (0.5, 0.6)):
            found = ground_truth.training_rows(frame, truth, *bounds, cap)
            assert sorted((r.ordinal, r.reason) for r in found.collect()) == taken_in_order(rows, {3, 7}, *bounds, cap)


def test_shingles_of_documents_stay_where_they_are(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"alpha{k} beta gamma delta and more words") for k in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, "nothing of it")], "item_id long, text string")
    pairs = lambda: {(r.doc_id, r.item_id) for r in passages.excerpt_pairs(docs, items).collect()}
    words = lambda rows, key: rows.select(key, passages.raw_words(rows["text"]).alias("words"))
    shared = passages.sharing(words(docs, "doc_id"), words(items, "item_id"), ["doc_id"], ["item_id"], 3)
    assert "SortMergeJoin" not in shared._jdf.queryExecution().sparkPlan().toString()
    wanted = {(k, 1) for k in range(50)}
    assert pairs() == wanted
    monkeypatch.setattr(passages, "BROADCAST_SHINGLES", 0)
    assert pairs() == wanted
