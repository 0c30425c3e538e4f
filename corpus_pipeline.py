"""A corpus pipeline over the ``documents`` table: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm import decontaminate, langid, mixing, ngram_join
from shiori.llm.common import release, scratch, written
from shiori.llm.queries import shard_digest, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the models are learned from the labelled rows of ``docs``.

    Null, empty and letterless texts are rejected; null ids and languages are not
    learned from, but such rows are judged as others; repeated rows are each
    judged.  Without a labelled row nothing can be identified, and all go.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the Jaccard similarity of five-word shingles (0.8) stays.

    It is the one of least id (a null id only where there is no other), and of
    repeated rows one; documents without words link with nothing and stay.
    """
    return ngram_join.keep_one(docs, n=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item (all words of a shorter one) go.

    Null and wordless texts and items hit nothing; with an empty benchmark all stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their targets; a document that is taken in part has its text cut at a word, and its ``n_chars``, if there, follows.

    A null source is a source of its own; documents without words are taken no times.
    """
    mixed = mixing.mix(docs, mixing.MixSpec(weights=(3.0, 1.0, 2.0), share=1.5, epochs=2.0))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(F.col("partial"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix placed into eight shards of near equal bytes; repetitions of a document are numbered and placed one by one."""
    return shard_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_ngrams),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the language models nor the near-duplicate join at any size; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before, which is then deleted.  An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            kept = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
