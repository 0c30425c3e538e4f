"""The contract queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from shiori.llm import alignment, decontaminate, html_crf, langid, media, mixing, ngram_join, quality, secrets, sharding, toxicity, warc
from shiori.llm.common import written
from shiori.llm.oracle import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = mixing.MixSpec(weights=(3.0, 1.0, 2.0), share=1.5, epochs=2.0)
    rows = written(mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source", spec.seed), "mix-sizes")
    return mixing.with_taken(rows, mixing.plan(rows, spec)).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The layout that op2 starts from: six shards by a hash of the id.
OLD_SHARDS, NEW_SHARDS = 6, 8


def shard_digest(docs: DataFrame) -> DataFrame:
    placed = sharding.reshard(docs, sharding.old_by_hash(OLD_SHARDS), OLD_SHARDS, NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), with_bytes=False)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = table(spark, sf_dir, "documents"), quality.QualitySpec(folds=4, held=2, threshold=0.7)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), spec), spec)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = table(spark, sf_dir, "documents"), langid.LangSpec(folds=5, held=0)
    return langid.identify(docs, langid.fit(docs, spec), spec)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = table(spark, sf_dir, "documents"), toxicity.ToxicSpec(folds=4, held=2, threshold=0.3)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), spec))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_media, op4_ngram_join, op5_html, op6_quality, op7_decontaminate, op8_langid, op9_secrets, op10_warc, op11_alignment, op12_toxicity)}
