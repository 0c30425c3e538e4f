"""Incremental upsert, drop, list, status and reindex over a store."""

from __future__ import annotations

import datetime
import logging
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.operators import search
from shiori.operators.embedding import embed
from shiori.operators.index import corpus, stored_postings
from shiori.schema import CHUNKS, HASHED, POSTINGS
from shiori.sources.files import collect_files, expand_drop_paths, is_uri, read_files, with_content
from shiori.sources.formats import chunks_of_file
from shiori.sources.staging import release, remove, staged
from shiori.sources.store import Store

log = logging.getLogger(__name__)

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


def today_utc() -> datetime.date:
    return datetime.datetime.now(datetime.timezone.utc).date()


def classify(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``action`` and ``old_created`` to files (source, file_hash): a left join with the stored metadata."""
    known = stored.groupBy("source").agg(F.max_by("file_hash", "updated").alias("_hash"), F.min("created").alias("old_created"))
    action = F.when(F.col("_hash").isNull(), NEW).when(F.col("_hash") == F.col("file_hash"), UNCHANGED).otherwise(CHANGED)
    return files.join(known, "source", "left").withColumn("action", action).drop("_hash")


def meta_rows(classified: DataFrame, today: Column) -> DataFrame:
    """Metadata of new and changed files; the day of first registration is kept."""
    return classified.filter(F.col("action") != UNCHANGED).select("source", "doc_name", F.coalesce("old_created", today).alias("created"), today.alias("updated"), "file_hash")


def upsert(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``stored`` with ``rows`` in the place of rows of the same source."""
    return stored.join(rows.select("source"), "source", "left_anti").select(*stored.columns).unionByName(rows.select(*stored.columns))


def without_sources(stored: DataFrame, sources: DataFrame) -> DataFrame:
    return stored.join(sources.select("source"), "source", "left_anti")


def parsed(files: DataFrame) -> DataFrame:
    """Adds ``chunks`` and ``failure``: a file that can't be parsed has no chunks and says why."""

    @F.pandas_udf("chunks array<string>, failure string")
    def parse(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        out = []
        for c, e in zip(content, ext, strict=True):
            try:
                out.append((chunks_of_file(bytes(c), e), None))
            except Exception as x:  # one bad file must not stop the others
                out.append((None, f"{type(x).__name__}: {x}"))
        return pd.DataFrame(out, columns=["chunks", "failure"])

    return files.withColumn("_p", parse("content", "ext")).select("*", "_p.chunks", F.coalesce("error", "_p.failure").alias("failure")).drop("_p")


@dataclass
class Outcome:
    updated: int
    failed: dict[str, str]


def update_files(spark: SparkSession, store: Store, paths: list[str], embedder, *, today: datetime.date | None = None, analyzer: str = "bigram", replace_all: bool = False) -> Outcome:
    """Registers or refreshes the files at ``paths``.

    Hashes decide what is read on; what is new or changed is parsed, embedded and
    indexed as one staged table, and appears with one publish.  A file that fails
    keeps its old version and is reported.  Paths with a scheme (``s3a://...``) are
    directories or files of a store that Spark reads.
    """
    remote = [p for p in paths if is_uri(p)]
    files = collect_files([p for p in paths if p not in remote])
    if not files and not remote:
        log.warning("no supported files")
        if replace_all:
            store.publish(truncate=(CHUNKS, HASHED, POSTINGS))
        return Outcome(0, {})
    base = store.version()
    stored = store.read(HASHED, base) if not replace_all else store.read(HASHED, base).limit(0)
    # Hashes first: the contents of what is new or changed alone are read on, and by path, not through the join.
    classified = staged(classify(read_files(spark, files, remote), stored).filter(F.col("action") != UNCHANGED), "classified")
    path = f"{store.path}/_staging/{uuid.uuid4().hex}"
    try:
        parsed(with_content(classified)).drop("content").write.parquet(path)
        return _publish_files(store, spark.read.parquet(path), base, embedder, today or today_utc(), analyzer, replace_all)
    finally:
        release(classified)
        remove(spark, path)


def _publish_files(store: Store, done: DataFrame, base: int, embedder, today: datetime.date, analyzer: str, replace_all: bool) -> Outcome:
    """One version from the staged, parsed files."""
    failed = {r.source: r.failure for r in done.filter("failure is not null").select("source", "failure").toLocalIterator()}
    for source, why in failed.items():
        log.error("%s: %s", source, why)
    good = done.filter("failure is null")
    count = good.count()
    if not count and not replace_all:
        return Outcome(0, failed)
    chunks = good.select("source", "doc_name", F.posexplode("chunks").alias("chunk_id", "chunk_text"))
    chunks = chunks.withColumn("vector", embed(F.col("chunk_text"), embedder))
    add = {HASHED: meta_rows(good, F.lit(today)), CHUNKS: chunks, POSTINGS: stored_postings(chunks, analyzer)}
    gone = good.filter(F.col("action") == CHANGED).select("source")
    store.publish(add, None if replace_all else gone, (CHUNKS, HASHED, POSTINGS) if replace_all else (), base)
    return Outcome(count, failed)


def drop_files(spark: SparkSession, store: Store, paths: list[str]) -> list[str]:
    """Takes the sources out of all tables (postings too); nothing happens on an empty store."""
    sources = expand_drop_paths(paths)
    if sources and store.version():
        store.publish(remove=spark.createDataFrame([(s,) for s in sources], "source string"))
    return sources


def keyword_filter(source: Column, keyword: str | None) -> Column:
    """LIKE %keyword%: ``%`` and ``_`` of the keyword act as wildcards, a backslash is itself."""
    return F.lit(True) if not keyword else source.like("%" + keyword.replace("\\", "\\\\") + "%")


def list_docs(meta: DataFrame, keyword: str | None = None, search_limit: int = 5) -> DataFrame:
    return meta.select("source", "doc_name").filter(keyword_filter(F.col("source"), keyword)).orderBy("source").limit(search_limit * 10)


def status(store: Store) -> list[dict]:
    told = store.manifest()
    return [{"name": n, "row_count": store.read(n, told["version"]).count(), "fields": store.schema(n).fieldNames(), "version": t["version"]} for n, t in sorted(told["tables"].items())]


def reindex(spark: SparkSession, store: Store, embedder=None, *, dry_run: bool = False, today: datetime.date | None = None) -> int:
    """Rebuilds everything from the registered sources; ``created`` starts anew, vanished files are lost and logged."""
    sources = [r.source for r in store.read(HASHED).select("source").distinct().orderBy("source").toLocalIterator()]
    if sources and not dry_run:
        found = set(collect_files(sources))
        for s in sources:
            if s not in found and not is_uri(s):
                log.warning("%s is gone", s)
        update_files(spark, store, sources, embedder, today=today, replace_all=True)
    return len(sources)


def search_store(store: Store, queries: DataFrame, embedder, *, limit: int = 5, k: int = 60, window: int = 1, analyzer: str = "bigram") -> DataFrame:
    """Hybrid search over the published tables; the terms asked for are pushed down to the postings' files."""
    if not store.exists(CHUNKS):
        raise LookupError("the store holds no documents; add some first")
    version = store.version()
    chunks, index = store.read(CHUNKS, version), store.read(POSTINGS, version)
    return search.hybrid(chunks, corpus(chunks, analyzer), queries, embedder, index=index, limit=limit, k=k, window=window, analyzer=analyzer)
