"""Small documents tables for the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)
