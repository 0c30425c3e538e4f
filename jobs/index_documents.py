"""Keeps an index of chunks in step with a table of documents that grows by files.

A file stream over the table's folder takes the files that no earlier run has taken
(its checkpoint knows them) and ends when there are no more.  Of each micro-batch the
documents are hashed and compared with the metadata of the batches before: unchanged
ones are passed over, new and changed ones are cut into chunks.  A batch writes

    <output>/meta/batch=<n>/                source, doc_name, created, updated, file_hash
    <output>/chunks/batch=<n>/bucket=<k>/   source, doc_name, chunk_id, chunk_text

and overwrites these folders alone, so a batch that is tried again after a failure
leaves what it would have left at first.  :func:`current` gives the index as it
stands: of each source, what the last batch that held it has written.

Edge cases: a null or empty text has metadata and no chunk; rows with a null id have
no name and are passed over (and counted in the log); of rows of one batch with equal
id the one of the greatest hash is taken; an empty table leaves an empty index;
columns other than the two named are not read.

    python -m jobs.index_documents --input documents.parquet --output index --checkpoint index-checkpoint
"""

from __future__ import annotations

import datetime
import logging
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobs import settings
from shiori.functions.text import file_name, sha256_hex
from shiori.operators.chunking import chunks_of, explode_chunks
from shiori.operators.ingest import UNCHANGED, classify, today_utc
from shiori.schema import CHUNK_OVERLAP, CHUNK_SIZE, META, MIN_CHUNK

log = logging.getLogger("jobs.index_documents")

CHUNKS = "source string, doc_name string, chunk_id long, chunk_text string"
#: As the store's metadata, and how many equal rows of the batch the document had.
REGISTERED = StructType([*META, StructField("copies", LongType())])


@dataclass(frozen=True)
class Settings:
    input: str = "documents.parquet"
    output: str = "index"
    checkpoint: str = "index-checkpoint"
    id_column: str = "doc_id"
    text_column: str = "text"
    files_per_batch: int = 64
    buckets: int = 16
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    least_chunk: int = MIN_CHUNK


def metadata(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """The last row of each source, with its ``batch``; of batches before one only, if that is named."""
    rows = stored(spark, f"{output}/meta", StructType([*REGISTERED, StructField("batch", LongType())]))
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    columns = [c for c in rows.columns if c != "source"]
    return rows.groupBy("source").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("source", *(F.col("r")[c].alias(c) for c in columns))


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the index as it stands, with their documents' days and hashes."""
    last = metadata(spark, output).drop("doc_name", "copies")
    chunks = stored(spark, f"{output}/chunks", CHUNKS + ", batch long, bucket int")
    return chunks.join(last, ["source", "batch"]).drop("batch", "bucket")


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table at a path; no rows before the first batch has written it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def written(rows: DataFrame, path: str, schema: StructType | str, *by: str) -> DataFrame:
    """``rows`` in the place of all that the folder holds, read back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def named(rows: DataFrame, of: Settings) -> DataFrame:
    """Rows as files: source, doc_name, file_hash, text."""
    source = F.concat(F.lit("documents/"), F.col(of.id_column).cast("string"), F.lit(".txt"))
    text = F.coalesce(F.col(of.text_column), F.lit(""))
    rows = rows.filter(F.col(of.id_column).isNotNull()).select(source.alias("source"), text.alias("text"))
    return rows.withColumn("doc_name", file_name(F.col("source"))).withColumn("file_hash", sha256_hex(F.col("text").cast("binary")))


def index_batch(rows: DataFrame, number: int, of: Settings, today: datetime.date) -> None:
    """One micro-batch: classified by hash, cut, and written to the folders of its number."""
    spark, meta_path, chunk_path = rows.sparkSession, f"{of.output}/meta/batch={number}", f"{of.output}/chunks/batch={number}"
    files = named(rows, of)
    counted = files.groupBy("source", "file_hash").agg(F.count(F.lit(1)).alias("copies"))
    taken = counted.groupBy("source").agg(F.max(F.struct("file_hash", "copies")).alias("t")).select("source", file_name(F.col("source")).alias("doc_name"), "t.*")
    classified = classify(taken, metadata(spark, of.output, number)).filter(F.col("action") != UNCHANGED)
    day = F.lit(today)
    meta = written(classified.select("source", "doc_name", F.coalesce("old_created", day).alias("created"), day.alias("updated"), "file_hash", "copies"), meta_path, REGISTERED)
    # What has just been registered is cut; the lists are as short as the batch is new, and Spark knows their sizes.
    key = ["source", "file_hash"]
    todo = files.join(meta.select(*key), key, "left_semi")
    again = meta.filter("copies > 1").select(*key)
    if again.head(1):
        todo = todo.join(again, key, "left_anti").unionByName(todo.join(again, key, "left_semi").dropDuplicates(key))
    chunks = explode_chunks(todo, chunks_of(F.col("text"), of.chunk_size, of.chunk_overlap, of.least_chunk), ["source", "doc_name"])
    chunks = written(chunks.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(of.buckets)).cast("int")), chunk_path, CHUNKS, "bucket")
    told = rows.agg(F.count(F.lit(1)), F.count(of.id_column)).first()
    made = meta.agg(F.count(F.lit(1)), F.count_if(F.col("created") < F.col("updated"))).first()
    log.info("batch %d: read %d rows of %s, %d without an id", number, told[0], of.input, told[0] - told[1])
    log.info("batch %d: wrote %d documents (%d registered before) to %s, %d chunks to %s", number, made[0], made[1], meta_path, chunks.count(), chunk_path)


def as_pattern(path: str) -> str:
    """The same path as a pattern: a file stream takes a table that is one file only so, and a folder as well."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, of: Settings, today: datetime.date | None = None) -> DataFrame:
    """Takes what is new, waits until it is indexed, and returns :func:`current`."""
    today = today or today_utc()
    schema = spark.read.parquet(of.input).select(of.id_column, of.text_column).schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", of.files_per_batch).parquet(as_pattern(of.input))
    writer = feed.writeStream.option("checkpointLocation", of.checkpoint).trigger(availableNow=True)
    stream = writer.foreachBatch(lambda rows, number: index_batch(rows, number, of, today)).start()
    stream.awaitTermination()
    log.info("index %s: %d documents", of.output, metadata(spark, of.output).count())
    return current(spark, of.output)


def main(argv: list[str] | None = None) -> int:
    of = settings.from_command_line(Settings, "index_documents.toml", "Index the documents that are new.", argv)
    spark = settings.session("index_documents")
    try:
        run(spark, of)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
