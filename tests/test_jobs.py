"""The jobs: growing input over two runs, repeats, failures, and the command line's settings."""

import datetime
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import index_documents, queries, search_report, settings
from shiori.operators.chunking import chunk_text

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2022, 1, 8)
SCHEMA = "doc_id long, text string, extra string"


def put(spark, rows, path):
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows_of(index):
    return sorted((r.source, r.chunk_id, r.chunk_text, r.created, r.updated, r.file_hash) for r in index.collect())


def expected(texts, created, updated):
    return sorted(
        (f"documents/{i}.txt", n, c, created.get(i, updated.get(i)), updated[i], hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in texts.items() for n, c in enumerate(chunk_text(t or ""))
    )


def test_index_grows_with_its_input(spark, tmp_path):
    of = index_documents.Settings(input=f"file://{tmp_path}/documents.parquet", output=f"file://{tmp_path}/index", checkpoint=f"file://{tmp_path}/checkpoint", buckets=3, files_per_batch=1)
    long = "文" * 900 + "。" + "字" * 700
    put(spark, [(1, "one"), (2, long), (3, None), (None, "no name"), (4, ""), (2, long), (5, "b"), (5, "a")], of.input)
    winner = max("ab", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    texts = {1: "one", 2: long, 3: None, 4: "", 5: winner}
    first = rows_of(index_documents.run(spark, of, DAY))
    assert first == expected(texts, {}, dict.fromkeys(texts, DAY))
    files = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    # Nothing new: nothing is written.
    assert rows_of(index_documents.run(spark, of, DAY + datetime.timedelta(1))) == first
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) == files
    # A changed document, one that is the same, a new one; one that is emptied.
    put(spark, [(1, "one changed"), (2, long), (6, "six")], of.input)
    put(spark, [(6, "six again"), (5, "")], of.input)
    later = DAY + datetime.timedelta(2)
    texts |= {1: "one changed", 6: "six again", 5: ""}
    got = rows_of(index_documents.run(spark, of, later))
    assert got == expected(texts, {i: DAY for i in range(1, 6)} | {6: later}, {1: later, 2: DAY, 3: DAY, 4: DAY, 5: later, 6: later})
    meta = spark.read.parquet(f"{of.output}/meta").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in meta)[0] == (0, 5) and sum(r["count"] for r in meta) == 9
    assert {r.updated for r in index_documents.metadata(spark, of.output).collect()} == {DAY, later}


def test_index_survives_a_failing_batch(spark, tmp_path, monkeypatch):
    of = index_documents.Settings(input=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/index", checkpoint=f"{tmp_path}/checkpoint")
    put(spark, [(i, f"text {i}") for i in range(20)], of.input)

    def broken(*_):
        raise OSError("no chunks today")

    with monkeypatch.context() as m:
        m.setattr(index_documents, "explode_chunks", broken)
        with pytest.raises(Exception, match="no chunks today"):
            index_documents.run(spark, of, DAY)
    assert index_documents.current(spark, of.output).count() == 0
    got = rows_of(index_documents.run(spark, of, DAY))
    assert got == expected({i: f"text {i}" for i in range(20)}, {}, dict.fromkeys(range(20), DAY))


def test_index_of_an_empty_table(spark, tmp_path):
    of = index_documents.Settings(input=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/index", checkpoint=f"{tmp_path}/checkpoint")
    put(spark, [], of.input)
    for _ in range(2):
        assert index_documents.run(spark, of, DAY).collect() == []


def test_report_keeps_other_days_and_repeats(spark, tmp_path):
    at = str(tmp_path)
    put(spark, [(1, "search engines"), (2, "cold widgets"), (3, None), (None, "search")], f"{at}/documents.parquet")
    spark.createDataFrame([(1, "search"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    of = search_report.Settings(documents=f"{at}/documents.parquet", queries=f"{at}/benchmark.parquet", output=f"{at}/out", day="2022-01-08", limit=1)
    first = sorted(search_report.run(spark, of).collect())
    assert [(r.query_id, r.source, r.method, r.text) for r in first] == [(1, "documents/1.txt", "Hybrid", "search engines"), (2, first[1].source, "Semantic", first[1].text)]
    put(spark, [(4, "search")], f"{at}/documents.parquet")
    other = search_report.Settings(**{**of.__dict__, "day": "2022-01-09"})
    assert search_report.run(spark, other).filter("query_id = 1").first().source == "documents/4.txt"
    assert spark.read.parquet(f"{at}/out/hits").filter(F.col("day") == "2022-01-08").count() == 2
    again = sorted(search_report.run(spark, other).collect())
    assert again == sorted(search_report.run(spark, other).collect())
    none = search_report.Settings(**{**of.__dict__, "output": f"{at}/none", "queries": f"{at}/empty.parquet"})
    spark.createDataFrame([], "item_id long, text string").write.parquet(none.queries)
    assert search_report.run(spark, none).count() == 0


def test_settings(tmp_path, capsys):
    of = settings.from_command_line(index_documents.Settings, "index_documents.toml", "", ["--input", "s3a://b/t", "--buckets", "4"])
    assert (of.input, of.output, of.buckets, of.chunk_size) == ("s3a://b/t", "index", 4, 1000)
    assert settings.from_command_line(search_report.Settings, "search_report.toml", "", []) == search_report.Settings()
    (tmp_path / "odd.toml").write_text("colour = 1\n")
    with pytest.raises(SystemExit):
        settings.from_command_line(search_report.Settings, "search_report.toml", "", ["--config", str(tmp_path / "odd.toml")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, name):
    sql = duckdb.connect()
    for t in ("documents", "benchmark"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    table = sql.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(table.column_names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[c] for c in columns)) for r in table.to_pylist())


def test_jobs_do_not_need_the_llm_package():
    import ast
    from pathlib import Path

    for path in Path(index_documents.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
