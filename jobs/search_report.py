"""A day's report of saved searches: the best chunks of all documents for every query of a table.

Documents are cut into chunks and embedded once into a table of the day,

    <output>/chunks/day=<day>/

and searched by all queries in blocks (full text and vectors, fused by rank, with the
text around each hit).  Hits are written to

    <output>/hits/day=<day>/method=<Hybrid|Keyword|Semantic>/

A run overwrites the folders of its day as a whole, so it can be repeated, and other
days stay.  Edge cases: null texts have no chunk, null queries are empty queries
(no full-text leg), rows with a null id are passed over; no query or no document: no hit.

    python -m jobs.search_report --documents documents.parquet --queries benchmark.parquet --output search-report
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from shiori.operators.chunking import chunks_of, explode_chunks
from shiori.operators.embedding import HashedEmbedder, StaticEmbedder, embed
from shiori.operators.index import corpus
from shiori.operators.ingest import today_utc
from shiori.operators.search import hybrid

log = logging.getLogger("jobs.search_report")

HITS = "query_id long, source string, chunk_id long, score double, text string, rank int"


@dataclass(frozen=True)
class Settings:
    documents: str = "documents.parquet"
    queries: str = "benchmark.parquet"
    output: str = "search-report"
    day: str = ""
    id_column: str = "doc_id"
    text_column: str = "text"
    query_id_column: str = "item_id"
    query_column: str = "text"
    limit: int = 5
    rrf_k: int = 60
    window: int = 1
    analyzer: str = "bigram"
    model_dir: str = ""
    hashed_dimensions: int = 64


def run(spark: SparkSession, of: Settings) -> DataFrame:
    """Writes the day's report and returns its hits, read back."""
    day = of.day or today_utc().isoformat()
    embedder = StaticEmbedder.shipped(spark, of.model_dir) if of.model_dir else HashedEmbedder(of.hashed_dimensions)
    docs = spark.read.parquet(of.documents)
    docs = docs.filter(F.col(of.id_column).isNotNull()).select(F.concat(F.lit("documents/"), F.col(of.id_column).cast("string"), F.lit(".txt")).alias("source"), F.col(of.text_column).alias("text"))
    chunks = explode_chunks(docs, chunks_of(F.col("text")), ["source"]).withColumn("vector", embed(F.col("chunk_text"), embedder, "double"))
    chunk_path, hit_path = f"{of.output}/chunks/day={day}", f"{of.output}/hits/day={day}"
    chunks.write.mode("overwrite").parquet(chunk_path)
    chunks = spark.read.schema(chunks.schema).parquet(chunk_path)
    asked = spark.read.parquet(of.queries).filter(F.col(of.query_id_column).isNotNull()).select(F.col(of.query_id_column).cast("long").alias("query_id"), F.col(of.query_column).alias("query"))
    read, queries = chunks.count(), asked.count()
    log.info("read %s: %d chunks; read %s: %d queries", of.documents, read, of.queries, queries)
    if read and queries:
        found = hybrid(chunks, corpus(chunks, of.analyzer), asked, embedder, limit=of.limit, k=of.rrf_k, window=of.window, analyzer=of.analyzer, kind="double")
    else:
        found = spark.createDataFrame([], HITS + ", method string")
    found.select("query_id", "source", "chunk_id", "score", "text", F.col("rank").cast("int").alias("rank"), "method").write.mode("overwrite").partitionBy("method").parquet(hit_path)
    hits = spark.read.schema(HITS + ", method string").parquet(hit_path)
    log.info("wrote %d hits to %s", hits.count(), hit_path)
    return hits


def main(argv: list[str] | None = None) -> int:
    of = settings.from_command_line(Settings, "search_report.toml", "Write the day's report of saved searches.", argv)
    spark = settings.session("search_report")
    try:
        run(spark, of)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
