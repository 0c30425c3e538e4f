"""Hostile and odd inputs of the readers, the command line, remote paths, many segments, blocks of queries."""

import datetime
import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori import cli
from shiori.operators import chunking, embedding, ingest, packing, search
from shiori.operators.index import corpus, found_in_chunks, found_in_postings, postings
from shiori.schema import CHUNKS, HASHED, META, POSTINGS
from shiori.sources import files, store as stores
from shiori.sources.formats import delimited, html, markup
from shiori.sources.store import Store
from shiori.streaming import watch

EMBED = embedding.HashedEmbedder(1024)
DAY = datetime.date(2022, 1, 8)


def test_files_of_repeated_options_add_up():
    for argv in (["add", "-f", "a", "-f", "b"], ["add", "--file", "a", "--file", "b"], ["add", "--files", "a", "b"], ["drop", "-f", "a", "--file", "b"], ["watch", "-f", "a", "b"]):
        assert cli.parser().parse_args(argv).files == ["a", "b"]


def test_delimited_marks_and_long_cells():
    assert delimited.chunks("﻿name,x\na,1", ",") == ["name: a, x: 1"]
    assert delimited.chunks("name\tx\n" + "y" * 300_000 + "\t1", "\t", 10) == [f"name: {'y' * 300_000}, x: 1"]


def test_deep_markdown():
    assert markup.markdown_sections(">" * 3000 + " deep") == [("", "deep")]
    assert "deep" in markup.markdown_sections("- " * 3000 + "deep")[0][1]
    assert markup.markdown_sections("\n".join(">" * (i % 7 + 1) + f" l{i}" for i in range(400)))
    assert markup.markdown_sections("> a\n> > b\n\n> > c\n> > d") == [("", "a\n\nb\n\nc\nd")]


@pytest.mark.parametrize("unit", ["*a ", "_a ", "**a ", "~~a ", "`a ``b ", "[a "])
def test_unpaired_marks_take_linear_time(unit):
    def taken(n):
        began = time.perf_counter()
        markup.inline(unit * n)
        return time.perf_counter() - began

    taken(10)
    assert taken(16_000) < 12 * taken(4_000) + 0.2


def test_marks_pair_as_before():
    shown = {"*a* b **c** d_e_f _g_ ~~h~~ *": "a b c d_e_f g h *", "a * b * c": "a * b * c", "**x*y**": "x*y", "*a *b*": "a *b", "__init__ x": "init x"}
    assert {k: markup.inline(k) for k in shown} == shown


def test_deep_html_takes_linear_time():
    began = time.perf_counter()
    assert len(html.sections("<div>x" * 30_000)) == 1
    assert html.sections("<h1>a</h1><p>b<ul><li>c<li>d</ul>") == [("a", "b\n\nc\n\nd")] or html.sections("<h1>a</h1><p>b")[0][0] == "a"
    assert time.perf_counter() - began < 10


def test_pack_rows_keeps_order_and_groups(spark):
    rows = [(k, i, "x" * (i % 9 + 1)) for k in ("a", "b", None) for i in range(200)] + [("a", 500, None), ("c", 1, "y" * 50)]
    got = packing.pack_rows(spark.createDataFrame(rows, "k string, o int, t string").repartition(5), ["k"], "o", "t", 20).collect()
    for k in ("a", "b", "c", None):
        expected = chunking.pack_lines([t for key, _, t in rows if key == k and t is not None], 20)
        assert [r.chunk_text for r in sorted((r for r in got if r.k == k), key=lambda r: r.chunk_id)] == expected


@pytest.mark.parametrize("seed", range(4))
def test_pack_rows_of_groups_over_many_blocks(spark, seed):
    """Blocks hardly longer than a chunk, empty lines, lines over several blocks, one group with most rows."""
    rng = random.Random(seed)
    size = rng.choice((1, 7, 40))
    rows = []
    for g in range(5):
        for i in range(rng.choice((1, 3, 600))):
            n = rng.choice((0, 1, 2, size, size + 1, 3 * size, rng.randrange(9), 40 * size if rng.random() < 0.1 else 1))
            rows.append((g or None, 1.5, i, "".join(rng.choice("aé文") for _ in range(n)), 7))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, h double, i int, t string, k0 int").repartition(3)
    got = {}
    for r in packing.pack_rows(df, ["g", "h"], "i", "t", size, block=1).collect():
        got.setdefault(r.g, {})[r.chunk_id] = r.chunk_text
    for g in {r[0] for r in rows}:
        expected = chunking.pack_lines([t for _, t in sorted((i, t) for own, _, i, t, _ in rows if own == g)], size)
        assert got.pop(g) == dict(enumerate(expected))
    assert not got
    assert packing.pack_rows(df.limit(0), ["g"], "i", "t", size).collect() == []


def test_pack_rows_spreads_one_group_over_all_tasks(spark, tmp_path):
    """A million lines of one group: read back in blocks, each by a task of its own."""
    lines = spark.range(1_000_000, numPartitions=8).select(F.lit("g").alias("g"), "id", F.concat(F.lit("line "), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("t"))
    packed = packing.pack_rows(lines, ["g"], "id", "t", 1000)
    packed.withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    tasks = back.groupBy("task").count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * back.count()
    expected = chunking.pack_lines((f"line {i}" + "x" * (i % 90) for i in range(1_000_000)), 1000)
    assert back.orderBy("chunk_id").select("chunk_text").toPandas()["chunk_text"].tolist() == expected


def test_unchanged_files_are_not_read_again(spark, tmp_path, monkeypatch):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    store = Store(spark, str(tmp_path / "db"))
    assert ingest.update_files(spark, store, [str(tmp_path)], EMBED).updated == 2
    (tmp_path / "b.txt").write_text("another text")
    seen = []
    monkeypatch.setattr(ingest, "with_content", lambda df: (seen.extend(r.source for r in df.collect()), files.with_content(df))[1])
    assert ingest.update_files(spark, store, [str(tmp_path)], EMBED).updated == 1
    assert seen == [str(tmp_path / "b.txt")]


def test_directories_of_a_store(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("a.md", "# A\n\nfirst text"), ("b.txt", "second"), ("c.exe", "no")):
        (tmp_path / "docs" / name).write_text(text)
    store, uri = Store(spark, str(tmp_path / "db")), f"file://{tmp_path}/docs"
    assert ingest.update_files(spark, store, [uri], EMBED).updated == 2
    assert ingest.update_files(spark, store, [uri], EMBED).updated == 0
    (tmp_path / "docs" / "b.txt").write_text("second, changed")
    assert ingest.update_files(spark, store, [uri], EMBED).updated == 1
    assert sorted(r.chunk_text for r in store.read(CHUNKS).collect()) == ["# A\nfirst text", "second, changed"]
    assert store.read(HASHED).count() == 2


def meta(spark, *sources, text="x"):
    return spark.createDataFrame([(s, s, DAY, DAY, text) for s in sources], META)


def test_upkeep_is_not_part_of_a_publish(spark, tmp_path, monkeypatch):
    """Publishes add segments; a fold leaves few, and the same rows; what was deleted stays so."""
    monkeypatch.setattr(stores, "FOLD", 3)
    store = Store(spark, str(tmp_path / "db"))
    for i in range(7):
        store.publish({HASHED: meta(spark, "same", f"own{i}", text=str(i))}, spark.createDataFrame([("same",)], "source string"))
    store.publish(remove=spark.createDataFrame([("own2",)], "source string"))

    def rows():
        return sorted((r.source, r.file_hash) for r in store.read(HASHED).collect())

    table = store.manifest()["tables"][HASHED]
    expected = sorted([("same", "6"), *((f"own{i}", str(i)) for i in range(7) if i != 2)])
    assert len(table["segments"]) == 7 and rows() == expected
    assert store.fold() > 0 and store.fold() == 0
    table = store.manifest()["tables"][HASHED]
    assert len(table["segments"]) <= 3 and len(table["tombstones"]) <= 3 and rows() == expected
    store.publish({HASHED: meta(spark, "own2", text="again")}, spark.createDataFrame([("own2",), ("same",)], "source string"))
    expected = sorted([("own2", "again"), *((f"own{i}", str(i)) for i in range(7) if i != 2)])
    assert rows() == expected
    store.compact()
    table = store.manifest()["tables"][HASHED]
    assert len(table["segments"]) == 1 and not table["tombstones"] and rows() == expected


def test_folding_rewrites_each_row_a_logarithm_of_times():
    """A thousand publishes of ten rows, folded whenever it is due."""
    parts, written, most = [], 0, 0
    for _ in range(1000):
        parts.append({"rows": 10})
        while own := stores.due(parts):
            rows = sum(p["rows"] for p in own)
            parts = [p for p in parts if not any(p is o for o in own)] + [{"rows": rows}]
            written += rows
        most = max(most, len(parts))
    assert sum(p["rows"] for p in parts) == 10_000
    assert written <= 10_000 * 4 and most <= stores.FOLD * 5


def test_concurrent_writers_lose_no_publish(spark, tmp_path):
    stores_of = [Store(spark, str(tmp_path / "db")) for _ in range(20)]
    with ThreadPoolExecutor(20) as pool:
        versions = list(pool.map(lambda x: x[1].publish({HASHED: meta(spark, f"s{x[0]}")}, base=0), enumerate(stores_of)))
    assert sorted(versions) == list(range(1, 21)) and stores_of[0].read(HASHED).count() == 20
    # The same source from the same base: the second fails; a fold between does not matter.
    store, base = stores_of[0], stores_of[0].version()
    store.publish({HASHED: meta(spark, "s3", text="y")}, spark.createDataFrame([("s3",)], "source string"), base=base)
    with pytest.raises(stores.Conflict):
        store.publish(remove=spark.createDataFrame([("s3",)], "source string"), base=base)
    base = store.version()
    assert store.fold() > 0
    store.publish(remove=spark.createDataFrame([("s4",)], "source string"), base=base)
    assert {r.source: r.file_hash for r in store.read(HASHED).collect()} == {f"s{i}": "y" if i == 3 else "x" for i in range(20) if i != 4}


def test_expire_keeps_pinned_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    for i in range(4):
        store.publish({HASHED: meta(spark, "a", text=str(i))}, spark.createDataFrame([("a",)], "source string"))
    (tmp_path / "db" / "_staging" / "left").mkdir(parents=True)
    store.compact()
    assert store.expire(3600) == 0 and len(store.versions()) == 5
    assert store.expire(-60, pinned=(2,)) >= 3
    assert store.versions() == [2, 5] and not list((tmp_path / "db" / "_staging").iterdir())
    assert [r.file_hash for r in store.read(HASHED, 2).collect()] == ["1"] and [r.file_hash for r in store.read(HASHED).collect()] == ["3"]
    assert store.expire(-60) > 0 and store.versions() == [5] and store.read(HASHED).count() == 1


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["abc", "abd", "xyz", "検索", "zz", "bcd"]
    texts = [(f"d{i}", c, " ".join(rng.choice(words, 4))) for i in range(30) for c in range(2)]
    chunks = spark.createDataFrame(texts, "source string, chunk_id long, chunk_text string").withColumn("vector", embedding.embed(F.col("chunk_text"), EMBED, "double"))
    queries = spark.createDataFrame([(q, " ".join(rng.choice(words, 2))) for q in range(23)] + [(50, None), (51, "a")], "query_id long, query string")

    def run(**more):
        return sorted(map(repr, search.hybrid(chunks, corpus(chunks), queries, EMBED, limit=3, k=60, window=1, kind="double", **more).collect()))

    base = run()
    assert run(index=postings(chunks)) == base
    monkeypatch.setattr(search, "QUERY_BLOCK", 6)
    assert run() == base
    monkeypatch.setattr(search, "DENSE", 1)
    monkeypatch.setattr(search, "LISTED", 5)
    assert run() == base


def test_found_in_chunks_equals_found_in_postings(spark):
    chunks = spark.createDataFrame([("a", 0, "abab"), ("a", 1, ""), ("b", 0, "bcab"), ("c", 0, None), ("d", 0, "zz")], "source string, chunk_id long, chunk_text string")
    terms = ["ab", "bc", "qq"]

    def rows(df):
        return sorted((r.source, r.chunk_id, r.dl, sorted(zip(r.at, r.tf, strict=True))) for r in df.collect())

    assert rows(found_in_chunks(chunks, terms)) == rows(found_in_postings(postings(chunks), terms)) == [("a", 0, 3, [(0, 2)]), ("b", 0, 3, [(0, 1), (1, 1)])]


def choosy():
    class Choosy(embedding.HashedEmbedder):
        """Fails on some text."""

        def __call__(self, texts):
            if any("boom" in (t or "") for t in texts):
                raise RuntimeError("no model")
            return embedding.HashedEmbedder(1024)(texts)

    return Choosy(1024)


def test_a_failing_change_costs_no_other_and_is_tried_again(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text("boom" if i == 3 else f"text {i}")
    store, ledger = Store(spark, str(tmp_path / "db")), str(tmp_path / "ck" / "failed")

    def feed(*paths, kind=watch.UPSERT):
        return spark.createDataFrame([(str(tmp_path / p), kind, 0) for p in paths], watch.SCHEMA)

    def told():
        return {(r.path.rpartition("/")[2], r.kind, r.attempts) for r in watch.failures(spark, ledger).collect()}

    assert told() == set()
    failed = watch.apply_changes(store, choosy(), feed(*(f"{i}.txt" for i in range(5))), ledger, 0)
    assert list(failed) == [str(tmp_path / "3.txt")] and "no model" in failed[str(tmp_path / "3.txt")]
    assert told() == {("3.txt", "upsert", 1)} and store.read(HASHED).count() == 4
    # Tried again with the next batch, whatever that brings.
    watch.apply_changes(store, choosy(), feed("5.txt"), ledger, 1)
    assert told() == {("3.txt", "upsert", 2)} and store.read(HASHED).count() == 5
    watch.apply_changes(store, EMBED, feed("0.txt", kind=watch.REMOVE), ledger, 2)
    assert told() == set() and {r.doc_name for r in store.read(HASHED).collect()} == {f"{i}.txt" for i in range(1, 6)}


def test_a_batch_without_a_model_is_kept_and_retried(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DB_PATH", str(tmp_path / "db"))
    monkeypatch.setattr(watch, "ATTEMPTS", 2)
    (tmp_path / "a.txt").write_text("boom a")
    (tmp_path / "b.txt").write_text("boom b")
    store, checkpoint = Store(spark, str(tmp_path / "db")), str(tmp_path / "db" / "_watch")
    rows = spark.createDataFrame([(str(tmp_path / n), watch.UPSERT, 0) for n in ("a.txt", "b.txt")], watch.SCHEMA)
    ledger = f"{checkpoint}/failed"
    assert len(watch.apply_changes(store, choosy(), rows, ledger, 0)) == 2
    cli.main(["status"], spark)
    assert capsys.readouterr().out.count("not applied (1 attempts): upsert") == 2
    assert len(watch.retry(store, choosy(), checkpoint)) == 2
    # Left alone after so many attempts, until the file changes.
    assert watch.retry(store, EMBED, checkpoint) == {} and not store.exists(HASHED)
    assert watch.apply_changes(store, EMBED, rows.limit(1), ledger, 1) == {}
    assert store.read(HASHED).count() == 1 and watch.failures(spark, ledger).count() == 1
    cli.main(["upkeep"], spark)


def test_a_step_is_tried_again_after_another_writer(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("text a")
    store, tried = Store(spark, str(tmp_path / "db")), []

    def update(*args):
        tried.append(1)
        if len(tried) < 3:
            raise stores.Conflict("version 1 exists already")

    monkeypatch.setattr(watch, "update_files", update)
    watch.apply_changes(store, EMBED, spark.createDataFrame([(str(tmp_path / "a.txt"), watch.UPSERT, 0)], watch.SCHEMA))
    assert len(tried) == 3
