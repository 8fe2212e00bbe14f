"""Helpers of these tests."""

EXTRA = "kept string, rid string, sid string, shingle string, part string"


def documents(spark, rows, partitions=3):
    """(doc_id, text) rows as documents with further columns whose names clash with internal ones."""
    full = [(i, t, "en", "host", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame(full, schema).repartition(partitions) if full else spark.createDataFrame([], schema)
