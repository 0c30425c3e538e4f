"""The jobs as registered queries: each runs twice into one new folder and returns what then stands there."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_documents, search_report
from shiori.plans.catalog import DAY, DIM, LIMIT, RRF_K, WINDOW
from shiori.plans.oracle import ORACLE_SQL as ENGINE
from shiori.sources.staging import shared_folder


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' chunks after two runs, of which the second finds nothing new."""
    at = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    of = index_documents.Settings(input=f"{sf_dir}/documents.parquet", output=f"{at}/index", checkpoint=f"{at}/checkpoint")
    for _ in range(2):
        out = index_documents.run(spark, of, datetime.date.fromisoformat(DAY))
    return out.select("source", "doc_name", "chunk_id", "chunk_text", "file_hash", *(F.col(c).cast("string").alias(c) for c in ("created", "updated")))


def job2_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's report of all benchmark queries after two runs."""
    at = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    of = search_report.Settings(documents=f"{sf_dir}/documents.parquet", queries=f"{sf_dir}/benchmark.parquet", output=at, day=DAY, limit=LIMIT, rrf_k=RRF_K, window=WINDOW, hashed_dimensions=DIM)
    for _ in range(2):
        out = search_report.run(spark, of)
    return out.select("query_id", "source", "chunk_id", F.round("score", 9).alias("score"), "method", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_search_report)}

ORACLE_SQL = {
    "job1_index_documents": f"""
SELECT 'documents/' || d.doc_id || '.txt' AS source, d.doc_id || '.txt' AS doc_name, chunk_id, chunk_text, sha256(coalesce(d.text, '')) AS file_hash, '{DAY}' AS created, '{DAY}' AS updated
FROM ({ENGINE["chunk_plain_text"]}) AS c JOIN documents d ON c.doc_id = d.doc_id
""",
    "job2_search_report": ENGINE["hybrid_batch"],
}
