"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

from shiori.operators import search
from shiori.plans import catalog
from shiori.sources.formats import html

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    table = sql.execute(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(table.column_names) == columns
    expected = sorted(repr(tuple(r[c] for c in columns)) for r in table.to_pylist())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == expected


def test_no_query_without_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_library_does_not_need_the_llm_package():
    import ast
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_vector_topk_asks_every_hundredth_row(spark, tmp_path, monkeypatch):
    """Ids beyond the first ten are asked, in several blocks, each against all rows."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(1050, 8)).astype(np.float32)
    order = rng.permutation(len(vectors))
    spark.createDataFrame([(int(i), vectors[i].tolist()) for i in order], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    got = {}
    for r in catalog.QUERIES["vector_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    wide = vectors.astype(np.float64)
    for q in range(0, 1050, 100):
        far = np.round(np.sqrt(((wide - wide[q]) ** 2).sum(1)), 9)
        assert got.pop(q) == dict(enumerate(np.lexsort((np.arange(len(far)), far))[:5].tolist()))
    assert not got


def test_adjacent_text_takes_every_turn(spark, tmp_path):
    turns = [(c, t, f"{c}.{t}") for c in (1, 2) for t in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.source, r.chunk_id): r.text for r in catalog.QUERIES["adjacent_text"](spark, str(tmp_path)).collect()}
    assert got == {(str(c), t): "\n".join(f"{c}.{n}" for n in range(max(t - 1, 0), min(t + 1, 4) + 1)) for c, t, _ in turns}


def test_stored_search_reads_the_table_as_it_is(spark, tmp_path):
    """Another table at the same path: its rows are found, not those of the run before."""
    def put(first, mode):
        rows = [(first + i, f"under the station {i} {'x' * i}") for i in range(8)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode(mode).parquet(str(tmp_path / "documents.parquet"))
        return {f"documents/{first + i}.txt" for i in range(8)}

    for first in (0, 100):
        known = put(first, "overwrite")
        spark.catalog.clearCache()
        got = {r.source for r in catalog.QUERIES["stored_search"](spark, str(tmp_path)).collect()}
        assert len(got) == 5 and got <= known


@pytest.mark.parametrize("window", [0, 1, 3, 9])
def test_all_contexts_over_blocks(spark, window):
    """Gaps in the ids, edges of blocks, and a window longer than a block: as the join gives it; one exchange."""
    rng = np.random.default_rng(3)
    turns = [(s, int(c), f"{s}.{c}") for s in ("a", "b") for c in np.flatnonzero(rng.random(40) < 0.8)]
    df = spark.createDataFrame(turns, "source string, chunk_id long, chunk_text string")
    got = search.all_contexts(df, window, block=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    expected = search.with_context(df.select("source", "chunk_id"), df, window)
    assert sorted(got.collect()) == sorted(expected.select("source", "chunk_id", "text").collect())


CUT_TITLE = "<html><body><nav>a</nav><h1>x &amp;&amp;&amp</h1><p>one &amp; two&lt;</p></body></html>"


@pytest.mark.parametrize("name", ["html_sections", "html_chunks"])
def test_references_cut_within_stay_as_the_sql_has_them(spark, tmp_path, name):
    """The file reader decodes them, as HTML5 does; the queries follow their SQL."""
    assert html.sections(CUT_TITLE)[1][0] == "x &&&" and html.sections(CUT_TITLE, bare=False)[1][0] == "x &&&amp"
    spark.createDataFrame([(1, CUT_TITLE)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    rows = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and any("&&&amp" in str(r) for r in rows)
