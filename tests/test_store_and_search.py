"""Store, ingest, search, rendering, watch and command line, end to end on small files."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori import cli
from shiori.config import Config
from shiori.operators import embedding, ingest, render, search
from shiori.operators.embedding import HashedEmbedder
from shiori.operators.index import corpus, postings
from shiori.schema import CHUNKS, HASHED, POSTINGS
from shiori.sources import files
from shiori.sources.store import Conflict, Store
from shiori.streaming import watch as W

EMBED = HashedEmbedder(64)
DAY = datetime.date(2022, 1, 8)


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# 見出し\n\nこれは検索のテストです。")
    (d / "c.exe").write_text("no")
    (d / "sub" / "b.TXT").write_text("hello world about search engines")
    (d / "empty.txt").write_text("")
    return d


def test_collect(tree):
    assert [p.rpartition("/")[2] for p in files.collect_files([str(tree), str(tree / "a.md"), "/nonexistent"])] == ["a.md", "empty.txt", "b.TXT"]
    assert files.collect_files([str(tree / "c.exe")]) == []
    assert files.expand_drop_paths(["/nonexistent/path/file.md"]) == ["/nonexistent/path/file.md"]
    assert len(files.expand_drop_paths([str(tree)])) == 4


def test_update_is_incremental(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert ingest.status(store) == [] and ingest.reindex(spark, store) == 0
    assert ingest.update_files(spark, store, [str(tree)], EMBED, today=DAY).updated == 3
    version = store.version()
    assert ingest.update_files(spark, store, [str(tree)], EMBED).updated == 0 and store.version() == version
    assert store.read(HASHED).count() == 3 and store.read(CHUNKS).count() == 2  # an empty file has a row and no chunk
    (tree / "a.md").write_text("# 見出し\n\n別の本文。")
    (tree / "bad.csv").write_text("a,b\n1\n")
    done = ingest.update_files(spark, store, [str(tree)], EMBED, today=DAY + datetime.timedelta(1))
    assert done.updated == 1 and list(done.failed) == [str(tree / "bad.csv")]
    row = store.read(HASHED).filter(F.col("doc_name") == "a.md").first()
    assert (row.created, row.updated, len(row.file_hash)) == (DAY, DAY + datetime.timedelta(1), 64)
    assert [r.chunk_text for r in store.read(CHUNKS).filter(F.col("doc_name") == "a.md").collect()] == ["# 見出し\n別の本文。"]
    # A changed file that no longer parses keeps its old version.
    (tree / "a.md").write_bytes(b"\xff\xff")
    assert ingest.update_files(spark, store, [str(tree / "a.md")], EMBED).failed
    assert store.read(CHUNKS).filter(F.col("doc_name") == "a.md").count() == 1
    before = {n: store.read(n).count() for n in (HASHED, CHUNKS, POSTINGS)}
    store.compact()
    assert before == {n: store.read(n).count() for n in before}
    assert {tuple(s["fields"]) for s in ingest.status(store) if s["name"] == HASHED} == {("source", "doc_name", "created", "updated", "file_hash")}


def test_drop_reindex_and_conflict(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    ingest.drop_files(spark, store, [str(tree)])
    assert store.version() == 0
    ingest.update_files(spark, store, [str(tree)], EMBED, today=DAY)
    assert ingest.reindex(spark, store, dry_run=True) == 3
    ingest.drop_files(spark, store, [str(tree / "sub")])
    assert store.read(HASHED).count() == 2
    assert store.read(POSTINGS).filter(F.col("source").endswith("b.TXT")).count() == 0
    (tree / "a.md").unlink()
    assert ingest.reindex(spark, store, EMBED, today=DAY) == 2 and store.read(HASHED).count() == 1
    old = store.version()
    store.publish(truncate=(CHUNKS,))
    with pytest.raises(Conflict):
        store.publish(truncate=(CHUNKS,), base=old)
    assert store.read(CHUNKS).count() == 0


def test_list(spark):
    meta = spark.createDataFrame([(s, s.rpartition("/")[2]) for s in ("/docs/alpha.md", "/docs/beta.md", "/notes/alpha.txt", "/x/a\\b.md")], "source string, doc_name string")
    assert ingest.list_docs(meta, "alpha").count() == 2
    assert ingest.list_docs(meta, "al_ha").count() == 2  # a wildcard
    assert ingest.list_docs(meta, "a\\b").count() == 1
    assert [r.source for r in ingest.list_docs(meta, None).collect()] == sorted(r.source for r in meta.collect())
    assert render.list_text([]) == "No documents registered."


def brute_bm25(chunks, query):
    sets = {k: embedding.bigrams(t) for k, t in chunks.items()}
    n, avg = len(sets), sum(map(len, sets.values())) / len(sets)
    out = {}
    for k, grams in sets.items():
        s = 0.0
        for t in set(embedding.bigrams(query)):
            df, tf = sum(t in g for g in sets.values()), grams.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(grams) / avg))
        if s:
            out[k] = round(s, 9)
    return sorted(out, key=lambda k: (-out[k], k))


def test_hybrid_against_brute_force(spark):
    texts = {("d%d" % (i // 3), i % 3): t for i, t in enumerate(["abcabc", "bcd", "zzz", "abc abc", "cab", "", "a", "xyz abc", "検索検索"])}
    chunks = spark.createDataFrame([(s, c, t) for (s, c), t in texts.items()], "source string, chunk_id long, chunk_text string").withColumn("vector", embedding.embed(F.col("chunk_text"), EMBED, "double"))
    asked = {0: "abc", 1: "検", 2: "", 3: "検索"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = search.hybrid(chunks, corpus(chunks), queries, EMBED, index=postings(chunks), limit=3, k=60, window=1).collect()
    vectors = {k: EMBED([t])[0] for k, t in texts.items()}
    for q, text in asked.items():
        keyword = brute_bm25(texts, text)[:3] if len(text) >= 2 else []
        v = EMBED([text])[0]
        semantic = sorted(vectors, key=lambda k: (round(float(np.sqrt(max(0, v @ v + vectors[k] @ vectors[k] - 2 * v @ vectors[k]))), 9), k))[:3]
        score = {}
        for leg in (keyword, semantic):
            for r, k in enumerate(leg):
                score[k] = score.get(k, 0) + 1 / (61 + r)
        best = sorted(score, key=lambda k: (-score[k], k))[:3]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.source, r.chunk_id) for r in own] == best
        for r in own:
            k = (r.source, r.chunk_id)
            assert r.method == ("Hybrid" if k in keyword and k in semantic else "Keyword" if k in keyword else "Semantic")
            assert r.score == pytest.approx(score[k])
            assert r.text == "\n".join(texts[k[0], c] for c in range(max(0, k[1] - 1), k[1] + 2) if (k[0], c) in texts)


def test_rrf(spark):
    assert spark.range(1).select(search.rrf(F.lit(0), 60)).first()[0] == pytest.approx(1 / 61, abs=1e-12)


def test_static_embedder(tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    with pytest.raises(FileNotFoundError):
        embedding.StaticEmbedder(str(tmp_path))
    tokenizer = Tokenizer(WordLevel({"a": 0, "b": 1, "out": 9, "[UNK]": 2}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    weights = np.zeros((3, 1024), "<f4")
    weights[0, 0], weights[1, 1] = 3, 4
    head = json.dumps({"embedding.weight": {"dtype": "F32", "shape": [3, 1024], "data_offsets": [0, weights.nbytes]}}).encode()
    (tmp_path / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + weights.tobytes())
    got = embedding.StaticEmbedder(str(tmp_path))(["a b out", "", "zzz"])
    assert got[0][:2] == pytest.approx([0.6, 0.8]) and np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-5)
    assert not got[1].any() and not got[2].any()


def test_relational_pooling(spark):
    rows = [[1.0, 2.0], [3.0, 6.0]]
    df = spark.createDataFrame([(rows,)], "r array<array<double>>")
    got = df.select(embedding.mean_pool(F.col("r")[0], F.col("r"))).first()[0]
    mean = np.mean(rows, axis=0)
    assert got == pytest.approx(mean / np.linalg.norm(mean))
    assert spark.range(1).select(embedding.l2(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_render(spark):
    hits = spark.createDataFrame([(0, 1 / 61, "Keyword", "/very/long/path/ファイル.md", 3, "a\nb" + "x" * 60)], "rank int, score double, method string, source string, chunk_id long, text string")
    line = render.as_text(hits).splitlines()[2]
    assert line == "0.0164   | Keyword    | /very/long/pa.. | a b" + "x" * 47 + "..."
    assert json.loads(render.as_json(hits))[0] == {"score": pytest.approx(1 / 61), "method": "Keyword", "source": "/very/long/path/ファイル.md", "chunk_id": 3, "text": "a\nb" + "x" * 60}


def test_watch(spark, tree, tmp_path):
    store, ck = Store(spark, str(tmp_path / "db")), str(tmp_path / "ck")
    W.watch(spark, store, [str(tree)], EMBED, ck, initial=True, once=True).awaitTermination()
    assert store.read(HASHED).count() == 3
    (tree / "sub" / "b.TXT").rename(tree / "sub" / "moved.txt")
    (tree / "new.txt").write_text("fresh")
    W.watch(spark, store, [str(tree)], EMBED, ck, once=True).awaitTermination()
    assert {r.doc_name for r in store.read(HASHED).collect()} == {"a.md", "empty.txt", "moved.txt", "new.txt"}
    assert W.difference({"a": [1, 1], "b": [1, 1]}, {"b": [2, 1], "c": [1, 1]}) == [("a", "remove"), ("b", "upsert"), ("c", "upsert")]


def test_cli(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DB_PATH", str(tmp_path / "db"))
    with pytest.raises(LookupError):
        cli.main(["--hashed", "64", "search", "検索"], spark)
    assert cli.main(["--hashed", "64", "add", "-f", str(tree)], spark) == 0
    cli.main(["--hashed", "64", "search", "検索", "--json"], spark)
    cli.main(["list", "b.TXT"], spark)
    cli.main(["status"], spark)
    cli.main(["reindex", "--dry-run"], spark)
    cli.main(["drop", "-f", str(tree)], spark)
    out = capsys.readouterr().out
    assert '"method": "Hybrid"' in out and "b.TXT" in out and "Database Status" in out
    assert Store(spark, str(tmp_path / "db")).read(HASHED).count() == 0


def test_init_fetches_what_is_missing(monkeypatch, tmp_path, capsys):
    source = tmp_path / "from"
    source.mkdir()
    for name in embedding.MODEL_FILES:
        (source / name).write_text(f"whole {name}")
    monkeypatch.setenv("MODEL_DIR", str(tmp_path / "model"))
    monkeypatch.delenv("MODEL_URL", raising=False)
    with pytest.raises(SystemExit):
        cli.main(["init"])
    monkeypatch.setenv("MODEL_URL", source.as_uri())
    assert cli.main(["init"]) == 0
    (source / "tokenizer.json").write_text("another")
    assert cli.main(["init", "--url", source.as_uri() + "/"]) == 0
    assert sorted(p.name for p in (tmp_path / "model").iterdir()) == sorted(embedding.MODEL_FILES)
    assert (tmp_path / "model" / "tokenizer.json").read_text() == "whole tokenizer.json"


def test_shipped_model(spark, tmp_path):
    """The model's folder is fetched by the tasks; where it lies on the driver does not matter."""
    from shiori.plans.catalog import made_up_model

    with pytest.raises(FileNotFoundError):
        embedding.StaticEmbedder.shipped(spark, str(tmp_path))
    folder = made_up_model(spark)
    model = embedding.StaticEmbedder.shipped(spark, folder)
    df = spark.createDataFrame([("small cold",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(embedding.embed(F.col("t"), model).alias("v")).collect()]
    own = embedding.StaticEmbedder(folder.removeprefix("file://"))(["small cold", "", None])
    assert np.allclose(got, own) and np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-5)


def test_config(monkeypatch, tmp_path):
    (tmp_path / ".env").write_text("SEARCH_LIMIT=7\nSEARCH_RRF_K=x\n# no\nDB_PATH=~/db\n")
    for name in ("SEARCH_LIMIT", "SEARCH_RRF_K", "DB_PATH"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("XDG_CACHE_HOME", "/cache")
    got = Config.load(str(tmp_path / ".env"))
    assert (got.search_limit, got.search_rrf_k, got.db_path, got.model_dir) == (7, 60, "~/db", "/cache/shiori/model")
