"""Language ID with more declared languages than are scored together."""

import random

from assayer.llm import language_id


def test_every_declared_language_is_a_hypothesis(spark):
    rng, rows = random.Random(6), []
    for k in range(150):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçøåß", 7)
        words = ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(20)]
        for _ in range(6 if k % 2 else 3):
            rows.append((len(rows), " ".join(rng.choices(words, k=60)), f"l{k:03d}", "host"))
        rows.append((len(rows), " ".join(rng.choices(words, k=60)), None, "host"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language_id.identify_documents(table).collect()}
    for k, (i, _, lang, _) in enumerate(rows):
        wanted = lang or rows[k - 1][2]
        assert (found[i].lang, found[i].text_lang, found[i].rejected) == (wanted, wanted, False)
