"""Schemas of the persistent tables and the constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: What the store holds, and how texts are cut.
DIMENSION = 1024
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 1000, 150, 200
EXTENSIONS = ("md", "adoc", "txt", "pdf", "html", "htm", "docx", "csv", "tsv")
HASHED, CHUNKS, POSTINGS = "doc_meta", "doc_chunk", "postings"

META = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("doc_name", T.StringType(), False),
    T.StructField("created", T.DateType(), False),
    T.StructField("updated", T.DateType(), False),
    T.StructField("file_hash", T.StringType(), False),
])
CHUNK = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("doc_name", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), True), False),
    T.StructField("chunk_id", T.LongType(), False),
    T.StructField("chunk_text", T.StringType(), False),
])
POSTING = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("chunk_id", T.LongType(), False),
    T.StructField("tf", T.LongType(), False),
    T.StructField("dl", T.LongType(), False),
])
TABLES = {CHUNKS: CHUNK, HASHED: META, POSTINGS: POSTING}
