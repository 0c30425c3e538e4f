"""Searches that pass over what cannot be among the best: as the full scan gives it, and how much was passed over."""

import uuid

import numpy as np
import pyarrow as pa
import pytest

from shiori.operators import blockmax, pivots, search
from shiori.operators.index import ANALYZERS, corpus, found_in_chunks


def new(tmp_path, name):
    return f"file://{tmp_path}/{name}-{uuid.uuid4().hex}"


def vectors_of(spark, rows):
    return spark.createDataFrame([("v", i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "source string, chunk_id long, vector array<float>").repartition(4)


def ranks(df):
    return sorted((r.query_id, r["rank"], r.source, r.chunk_id, round(r.score, 6)) for r in df.collect())


def brute(vectors, queries, limit):
    """Distances of differences; ties in order of the ids."""
    wide = np.array(vectors, np.float64)
    out = []
    for q in queries:
        far = np.round(np.sqrt(((wide - wide[q]) ** 2).sum(1)), 9)
        out += [(q, k, "v", int(i), round(-float(far[i]), 6)) for k, i in enumerate(np.lexsort((np.arange(len(far)), far))[:limit])]
    return sorted(out)


def test_pivots_equal_the_scan_and_skip(spark, tmp_path, monkeypatch):
    """Clusters, a third of the rows equal, rows without a vector; several blocks of queries."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 10
    rows = list((centres[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 16)) * 0.3).astype(np.float32)) + [centres[0].astype(np.float32)] * 1000
    df = vectors_of(spark, [*rows, None])
    some = df.filter("chunk_id % 100 = 0").selectExpr("chunk_id AS query_id", "vector")
    laid = pivots.Pivots.lay_out(df, new(tmp_path, "laid"), pivots=40)
    assert sum(laid.rows) == 3000
    expected = brute(rows, range(0, 3000, 100), 5)
    made = spark.sparkContext.accumulator(0)
    assert ranks(laid.nearest(some, 5, made)) == expected
    asked = 30 * 3000
    assert 0 < made.value < asked / 2, f"{made.value} of {asked} distances"
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert ranks(laid.nearest(some, 5)) == expected


@pytest.mark.parametrize("seed", range(3))
def test_pivots_without_clusters(spark, tmp_path, seed):
    """Little can be passed over, more is asked than a cell holds, ties stand everywhere: still the same rows."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 3, (150, 4))
    df = vectors_of(spark, rows)
    some = df.filter("chunk_id % 10 = 0").selectExpr("chunk_id AS query_id", "vector")
    laid = pivots.Pivots.lay_out(df, new(tmp_path, "laid"), pivots=90)
    for limit in (1, 7, 200):
        assert ranks(laid.nearest(some, limit)) == brute(rows, range(0, 150, 10), limit)


def test_pivots_of_nothing(spark, tmp_path):
    df = vectors_of(spark, [None])
    laid = pivots.Pivots.lay_out(df, new(tmp_path, "laid"))
    assert laid.nearest(df.selectExpr("chunk_id AS query_id", "vector"), 5).collect() == []
    assert laid.nearest(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 5).collect() == []


def test_ties_of_a_batch_are_cut(spark):
    """Equal rows do not all leave their batch: the first by source and chunk do, as many as are asked for."""
    part = pa.RecordBatch.from_arrays([pa.array(["b", "a", "b", "a", "c"]), pa.array([2, 9, 1, 10, 0]), pa.array([0] * 5)], names=["source", "chunk_id", "x"])
    got = search.best(np.array([4, 7]), np.array([[1.0, 1, 1, 1, 1], [1, 2, 3, 4, 5]]), part, 2)
    assert sorted(zip(*(c.to_pylist() for c in got.columns))) == [(4, "a", 9, 1.0), (4, "a", 10, 1.0), (7, "a", 10, 4.0), (7, "c", 0, 5.0)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_equal_vectors_are_equally_far(spark, partitions):
    """Copies of the query, and rows a millionth of its length away, in order whatever is multiplied with them."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=64)
    rows = [v if i % 3 else v * (1 + 1e-7 * (i + 1)) for i in range(60)] + list(rng.normal(size=(60, 64)))
    df = spark.createDataFrame([("v", i, x.tolist()) for i, x in enumerate(rows)], "source string, chunk_id long, vector array<double>").repartition(partitions)
    got = search.nearest(df, df.filter("chunk_id = 1").selectExpr("chunk_id AS query_id", "vector"), 45)
    assert ranks(got) == brute(rows, [1], 45)


def chunks_of(spark, texts):
    return spark.createDataFrame([(f"s{i % 7}", i, t) for i, t in enumerate(texts)], "source string, chunk_id long, chunk_text string").repartition(4)


def scanned(spark, df, queries, limit, analyzer):
    terms = sorted({t for _, q in queries if q and len(q) >= 2 for t in ANALYZERS[analyzer](q)})
    asked = [(i, terms.index(t)) for i, q in queries if q and len(q) >= 2 for t in set(ANALYZERS[analyzer](q))]
    return search.full_text_leg(found_in_chunks(df, terms, analyzer), corpus(df, analyzer), terms, asked, limit)


@pytest.mark.parametrize("analyzer", ["word", "bigram"])
def test_blocks_equal_the_scan_and_are_skipped(spark, tmp_path, analyzer, monkeypatch):
    """Sources have common words and some of their own; a quarter of the chunks are equal."""
    rng = np.random.default_rng(11)
    common, weight = [f"w{i}" for i in range(100)], 1 / np.arange(1, 101)
    own = lambda s: [chr(0x4E00 + 9 * s + k) * 2 for k in range(9)]
    texts = [" ".join([*rng.choice(common, rng.integers(1, 40), p=weight / weight.sum()), *rng.choice(own(i % 40), rng.integers(1, 5))]) for i in range(1500)]
    texts += ["w0 w1 w2 w3"] * 500 + ["", None]
    df = spark.createDataFrame([(f"s{i % 40}", i, t) for i, t in enumerate(texts)], "source string, chunk_id long, chunk_text string").repartition(4)
    queries = [(1, f"{own(3)[0]} w30"), (2, "w0"), (3, f"{own(7)[1]} {own(7)[2]} w1 w0"), (4, f"w99 {own(20)[5]}"), (5, "x"), (6, None), (7, "no such word")]
    told = spark.createDataFrame(queries, "query_id long, query string")
    index = blockmax.BlockIndex.build(df, new(tmp_path, "index"), analyzer, block=16)
    seen = []
    expected = ranks(scanned(spark, df, queries, 5, analyzer))
    assert ranks(index.top_k(told, 5, told=seen)) == expected
    assert 0 < sum(s for _, s in seen) < sum(b for b, _ in seen) / 2, seen
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(blockmax, "PUSHED_BLOCKS", 3)
    assert ranks(index.top_k(told, 5)) == expected


def test_bound_holds_for_every_chunk(spark, tmp_path):
    """Whatever blocks are asked for first, and however they are cut, the hits are the same."""
    rng = np.random.default_rng(2)
    df = chunks_of(spark, [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(200)])
    queries = [(1, "a b"), (2, "c z"), (9, "h h h a")]
    told = spark.createDataFrame(queries, "query_id long, query string")
    expected = {n: ranks(scanned(spark, df, queries, n, "word")) for n in (1, 20)}
    for block in (1, 8):
        index = blockmax.BlockIndex.build(df, new(tmp_path, "index"), "word", block=block)
        for n, first in ((1, 1), (20, 2)):
            assert ranks(index.top_k(told, n, first)) == expected[n]


def test_blocks_of_nothing(spark, tmp_path):
    empty = blockmax.BlockIndex.build(chunks_of(spark, ["x"]).limit(0), new(tmp_path, "index"))
    told = spark.createDataFrame([(1, "some query"), (2, "")], "query_id long, query string")
    assert empty.top_k(told, 5).collect() == []
    assert empty.top_k(told.limit(0), 5).collect() == []


def test_no_row_of_a_build_holds_all_terms_of_a_block(spark, tmp_path, monkeypatch):
    """What is written on the way is read in batches of thousands of rows, so a row is a term's postings in a block, at most."""
    monkeypatch.setattr(blockmax, "remove", lambda *a: None)
    chunks = spark.createDataFrame([("s", i, f"words number {i} and {i * 7919}") for i in range(40)], "source string, chunk_id long, chunk_text string")
    blockmax.BlockIndex.build(chunks, str(tmp_path / "index"), block=16)
    whole = spark.read.parquet(f"{next((tmp_path / 'index').glob('whole-*'))}")
    assert not any("struct" in kind for _, kind in whole.dtypes)
    assert all(max(len(x) for x in r if isinstance(x, list)) <= 16 for r in whole.collect()) and whole.filter("term is not null").count() > 100
