"""Postings as they are stored, against those counted chunk by chunk."""

import pytest
from pyspark.sql import functions as F

from shiori.operators import index, search
from shiori.operators.embedding import HashedEmbedder, embed

TEXTS = ["abab", "", None, "A", "\u0130x\u0130x", "\U0001f600\U0001f600 a", "das Haus das"] + [f"text {i} of many {i * i}" for i in range(40)]


def chunks_of(spark):
    return spark.createDataFrame([(f"s{i % 5}", i, t) for i, t in enumerate(TEXTS)], "source string, chunk_id long, chunk_text string").repartition(3)


@pytest.mark.parametrize("analyzer", ["bigram", "word"])
def test_stored_postings_equal_postings(spark, tmp_path, monkeypatch, analyzer):
    monkeypatch.setattr(index, "GROUP", 8)
    chunks = chunks_of(spark)
    stored = index.stored_postings(chunks, analyzer)
    expected = index.postings(chunks, analyzer)
    assert stored.dtypes == expected.dtypes and sorted(map(tuple, stored.collect())) == sorted(map(tuple, expected.collect()))
    # What is shuffled is a row for each term of a group; files are sorted.
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression [term")
    stored.write.parquet(str(tmp_path / "p"))
    files = spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name()).agg(F.collect_list("term").alias("t")).collect()
    assert all(r.t == sorted(r.t) for r in files)


def test_hashed_embedder_counts_each_bigram():
    from collections import Counter

    import numpy as np

    from shiori.operators import embedding

    got = embedding.HashedEmbedder(64)(TEXTS)
    for text, row in zip(TEXTS, got, strict=True):
        own = np.zeros(64)
        for gram, n in Counter(embedding.bigrams(text or "")).items():
            own[embedding._slot(gram, 64)] += n
        assert np.array_equal(row, embedding.unit(own))
    assert embedding.HashedEmbedder(8)(["", None, "a"]).tolist() == [[0.0] * 8] * 3 and embedding.HashedEmbedder(8)([]).shape == (0, 8)


def test_common_terms_are_scanned_with_the_same_result(spark, monkeypatch):
    chunks = chunks_of(spark).withColumn("vector", embed(F.col("chunk_text"), HashedEmbedder(8)))
    queries = spark.createDataFrame([(1, "text of many"), (2, "das")], "query_id long, query string")
    asked, real = [], search.found_in_postings
    monkeypatch.setattr(search, "found_in_postings", lambda *a: asked.append(1) or real(*a))
    got = []
    for scan in (0, 1000):
        monkeypatch.setattr(search, "SCAN", scan)
        got.append(sorted(map(tuple, search.hybrid(chunks, index.corpus(chunks), queries, HashedEmbedder(8), index=index.postings(chunks)).collect())))
        assert len(asked) == (scan > 0)
    assert got[0] == got[1] and got[0]
