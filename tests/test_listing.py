"""The data source of files and the table function."""

import os

import pytest
from pyspark.sql import functions as F

from shiori.functions import tables
from shiori.operators.chunking import chunk_text
from shiori.sources import files, listing


@pytest.fixture
def tree(tmp_path):
    for k in range(5):
        (tmp_path / f"d{k}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"d{k}" / "a.md").write_text(f"# T{k}\n\ntext")
        (tmp_path / f"d{k}" / "deep" / "b.TXT").write_text("x")
        (tmp_path / f"d{k}" / "deep" / "er" / "c.exe").write_text("no")
    (tmp_path / "top.csv").write_text("a,b\n1\n")
    (tmp_path / "empty.txt").write_text("")
    return tmp_path


def test_lists_what_the_walk_lists(spark, tree, monkeypatch):
    expected = sorted(files.walk(str(tree)))
    df = listing.document_files(spark, [str(tree), str(tree / "nothing")])
    assert sorted(r.path for r in df.collect()) == expected and df.columns == ["path", "doc_name", "ext", "size", "mtime"]
    assert df.rdd.getNumPartitions() > 3
    assert [r.path for r in listing.document_files(spark, [str(tree / "top.csv")]).collect()] == [str(tree / "top.csv")]
    assert listing.document_files(spark, [str(tree / "nothing")]).count() == 0
    assert [r.path for r in listing.document_files(spark, [f"file://{tree}/d1"]).filter("ext = 'md'").collect()] == [f"file://{tree}/d1/a.md"]


def test_planner_lists_no_further_than_it_must(tree, monkeypatch):
    seen = []
    children = listing.children
    monkeypatch.setattr(listing, "children", lambda fs, at: seen.append(at) or children(fs, at))
    monkeypatch.setattr(listing, "PARTS", 4)
    reader = listing._Reader([str(tree)], False)
    parts = reader.partitions()
    assert seen == [str(tree)] and sum(len(p.folders) for p in parts) == 5
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(files.walk(str(tree)))


def test_filters_reach_the_source(spark, tree, monkeypatch):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = listing.document_files(spark, [str(tree)]).filter(F.col("path").startswith(f"{tree}/d2/") & F.col("ext").isin("txt", "exe"))
        assert [r.path for r in df.collect()] == [f"{tree}/d2/deep/b.TXT"]
        assert "StartsWith" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    # A subtree that no wanted path lies in is not listed.
    seen = []
    children = listing.children
    monkeypatch.setattr(listing, "children", lambda fs, at: seen.append(os.path.relpath(at, tree)) or children(fs, at))
    monkeypatch.setattr(listing, "PARTS", 1000)
    reader = listing._FilteringReader([str(tree)], False)
    assert list(reader.pushFilters([listing.EqualTo(("path",), f"{tree}/d3/a.md"), listing.EqualTo(("size",), 3)])) == [listing.EqualTo(("size",), 3)]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["a.md"] and sorted(seen) == [".", "d3"]


def test_content_and_errors(spark, tree):
    (tree / "bad.txt").write_bytes(b"\xff\xfe\xff")
    rows = {r.doc_name: r for r in listing.document_files(spark, [str(tree)], content=True).collect() if not r.path.startswith(f"{tree}/d")}
    assert rows["empty.txt"].chunks == [] and rows["empty.txt"].error is None
    assert "fields" in rows["top.csv"].error and rows["top.csv"].chunks is None and rows["bad.txt"].error
    assert len(rows["bad.txt"].file_hash) == 64


def test_chunks_in_sql(spark):
    tables.register(spark)
    text = "あ" * 900 + "。" + "い" * 1900
    docs = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "short")], "id int, t string")
    got = spark.sql("SELECT id, chunk_id, chunk_text FROM {docs}, LATERAL chunks(t) ORDER BY id, chunk_id", docs=docs).collect()
    assert [(r.id, r.chunk_id, r.chunk_text) for r in got] == [(i, n, c) for i, t in ((1, text), (4, "short")) for n, c in enumerate(chunk_text(t))]
    got = spark.sql("SELECT chunk_text FROM {docs}, LATERAL chunks(t, 100, 10, 0) WHERE id = 1 ORDER BY chunk_id", docs=docs).collect()
    assert [r.chunk_text for r in got] == chunk_text(text, 100, 10, 0)
    for wrong in ("chunks(1)", "chunks('a', 0)", "chunks('a', 10, 10)", "chunks('a', id)"):
        with pytest.raises(Exception, match="chunks: "):
            spark.sql(f"SELECT * FROM {{docs}}, LATERAL {wrong}", docs=docs).collect()
