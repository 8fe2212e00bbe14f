"""Quality, secrets, language ID and the pipeline."""

import re

import corpus_pipeline
import numpy as np
from assayer.llm import language_id, quality, secrets
from conftest_llm import documents
from test_dedup import jaccard

SF = "/root/testdata/sf0.001"


def test_base_spans():
    text = 'é PASSWORD="abcdefghijkl" token: short1 api_key=0123456789abcdef0123 AKIA0123456789ABCD AKIA12 0123456789abcde'
    kinds = [(secrets.KINDS[k], text[s:e]) for s, k, e in sorted(secrets.base_spans(text))]
    assert kinds == [("assign", 'PASSWORD="abcdefghijkl'), ("assign", "api_key=0123456789abcdef0123"), ("hex", "0123456789abcdef0123"), ("access", "AKIA0123456789ABCD")]
    plain = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
        "access": ("AKIA[A-Z0-9]+", 0, 18, 0),
        "hex": ("[0-9a-f]+", 0, 16, 0),
    }
    for name, (pattern, group, least, flags) in plain.items():
        wanted = [m.span() for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
        assert [(s, e) for s, k, e in secrets.base_spans(text) if secrets.KINDS[k] == name] == wanted


def test_novelty_reports_random_strings_only():
    novelty = secrets.Novelty()
    key, name = "Qx7/pZ93kLmNvB2wTrY8uE4s", "SELECT_get_value_set_value_Max_length2"
    text = f"Authorization: Bearer {key} and private key {name}"
    assert [text[s:e] for s, _, e in secrets.novel_spans(text, [], novelty)] == [key]
    assert secrets.novel_spans(f"a plain word {key}", [], novelty) == []


def test_scan_and_redact(spark, corpus):
    found = {r.doc_id: r for r in secrets.scan(documents(spark, corpus)).collect()}
    hit = [i for i, r in found.items() if r.spans]
    assert len(hit) == 1 and (found[hit[0]].n_assign, found[hit[0]].n_access, found[hit[0]].n_hex, found[hit[0]].n_novel) == (1, 1, 1, 1)
    out = {r.doc_id: r for r in secrets.redact(documents(spark, corpus)).collect()}
    assert out[hit[0]].text.count("[SECRET]") == 4 and out[hit[0]].n_chars == len(out[hit[0]].text)
    assert all(out[i].text == t for i, t in corpus if i != hit[0])
    assert secrets.scan(documents(spark, [])).count() == 0


def test_quality_held_out(spark):
    frame = quality.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = (frame.score[frame.quality == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (frame.predicted == frame.quality).mean() > 0.9
    assert frame.score.between(0, 1).all() and (frame.predicted == (frame.score >= 0.3)).all()


def test_quality_of_awkward_rows(spark, corpus):
    rows = documents(spark, [*corpus, (None, "some text")])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (3, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        found = quality.score(rows, marks).collect()
        assert len(found) == len(corpus) + 1
        assert all(0 <= r.score <= 1 for r in found)
    assert quality.score(documents(spark, []), labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    level = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert np.allclose(level, [0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3])


def test_language(spark):
    english, french = "the thing and that which they would have there with this", "les choses que nous avons dans cette maison avec une autre pour"
    rows = [(i, (english if i % 3 else french).split()[i % 5 :], "en" if i % 3 else "fr") for i in range(60)]
    rows = [(i, " ".join(w), lang) for i, w, lang in rows] + [(100, english, "fr"), (101, french, None), (102, None, "en"), (103, "", "fr"), (104, "12 !!", "en"), (None, english, "en")]
    table = spark.createDataFrame([(*r, "h", "x") for r in rows], "doc_id long, text string, lang string, source string, declared string")
    found = {r.doc_id: r for r in language_id.identify_documents(table).collect()}
    assert len(found) == len(rows)
    assert (found[100].lang, found[101].lang, found[None].lang) == ("en", "fr", "en")
    assert all(found[i].rejected and found[i].lang == "und" for i in (102, 103, 104))
    assert all(found[i].lang == lang and not found[i].rejected for i, _, lang in rows[:60])
    assert language_id.identify_documents(table.limit(0)).count() == 0
    silent = language_id.identify_documents(table.withColumn("lang", table.lang.substr(1, 0)).replace("", None, "lang")).collect()
    assert all(r.lang == "und" and r.rejected for r in silent)


def test_language_of_pages(spark):
    found = language_id.language_id_pages(spark, SF).toPandas()
    assert (found.lang == found.declared).mean() > 0.95


def test_pipeline_stages(spark, corpus):
    """Each stage against a brute-force version of its decision."""
    docs = documents(spark, corpus)
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert not {i for i, t in corpus if not (t or "").strip()} & left.keys()
    exact = corpus_pipeline.exact_stage(spark, docs, SF).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault("".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}), []).append((-len(t or ""), i))
    assert sorted(r.doc_id for r in exact) == sorted(min(x)[1] for x in groups.values())
    once = list(dict(corpus).items())
    near = corpus_pipeline.jaccard_stage(spark, documents(spark, once), SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in jaccard(once).values()})


def test_stages_drop_rows_not_ids(spark):
    """Repeated and null ids: a near copy goes, a text of its own with the same id stays."""
    own = " ".join(f"a{k}" for k in range(60))
    near, other = own.replace("a59", "b"), " ".join(f"c{k}" for k in range(60))
    docs = documents(spark, [(3, own), (5, near), (5, other), (None, other + " end"), (None, "one two three four five")])
    kept = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, SF).collect())
    assert kept == sorted([(3, own), (5, other), (-1, "one two three four five")])
    exact = corpus_pipeline.exact_stage(spark, documents(spark, [(5, own), (5, other), (6, own), (None, own), (5, own)]), SF).collect()
    assert sorted((r.doc_id, r.text) for r in exact) == sorted([(5, own), (5, other)])
    empty = documents(spark, [])
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(found.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "secret_scan", "packing"]
