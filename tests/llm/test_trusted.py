"""Toxic documents are no trusted text."""

from nestra.llm import perplexity


def test_toxic_documents_are_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (5, 1, 0), (5, 0, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r[0] for r in perplexity.trusted_documents(labels).collect()) == [1, 3]
    docs = spark.createDataFrame([(1, "aa ab ba", "x"), (2, "zq qz zz", "x")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["trusted"] for r in perplexity.score(docs, labels).collect()}
    assert got == {1: True, 2: False}
