"""The inverted index: postings of chunks, with term frequencies and chunk lengths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.operators.embedding import bigram_counts, bigrams

_WORD = re.compile(r"\w+")

#: Analyzers: text to its terms.
ANALYZERS = {"bigram": bigrams, "word": lambda text: _WORD.findall(text.lower())}
#: So many terms are pushed down to the postings' files.
PUSHED_TERMS = 2_000
#: Chunks whose postings are shuffled together.
GROUP = 512
#: Of chunks that hold any of some numbered terms: which (``at``), how often (``tf``), and the chunk's length (``dl``).
FOUND = "source string, chunk_id long, dl long, at array<int>, tf array<int>"


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def postings(chunks: DataFrame, analyzer: str = "bigram") -> DataFrame:
    """(term, source, chunk_id, tf, dl) of chunks (source, chunk_id, chunk_text); terms are counted per chunk before anything is shuffled."""
    terms = ANALYZERS[analyzer]
    schema = "term string, source string, chunk_id long, tf long, dl long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            out: list[list] = [[], [], [], [], []]
            for source, chunk, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = terms(text or "")
                for term, tf in Counter(found).items():
                    for column, value in zip(out, (term, source, chunk, tf, len(found)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["term", "source", "chunk_id", "tf", "dl"])

    return chunks.select("source", "chunk_id", "chunk_text").mapInArrow(count, schema)


def _grouped(texts: list[str | None], analyzer: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of at most GROUP texts: their terms in order, how many texts hold each, and term by term which (by place) and how often; and the texts' lengths."""
    if analyzer != "bigram":
        found = [ANALYZERS[analyzer](t or "") for t in texts]
        told = sorted((t, at, n) for at, own in enumerate(found) for t, n in Counter(own).items())
        terms, which = np.unique(np.array([t for t, _, _ in told], object), return_inverse=True) if told else ([], np.zeros(0, np.int64))
        return list(terms), np.bincount(which, minlength=len(terms)), np.array([at for _, at, _ in told], np.int64), np.array([n for _, _, n in told], np.int64), np.array([len(x) for x in found], np.int64)
    return bigram_counts(texts)


def stored_postings(chunks: DataFrame, analyzer: str = "bigram", salts: int = 8) -> DataFrame:
    """:func:`postings` as they are stored: hot terms over several files, each file sorted by term.

    A row for each term of GROUP chunks is shuffled and sorted, and told apart after
    that; a row a posting would cost many times as much.  Terms are dealt by hash: to
    deal them by range, all chunks would be read twice.
    """
    schema = "term string, salt int, source array<string>, chunk_id array<long>, tf array<int>, dl array<int>"

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, GROUP):
            terms, n, at, tf, dl = _grouped(part.column(2).to_pylist(), analyzer)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            place = pa.array(at, pa.int64())
            salt = zlib.crc32(f"{part.column(0)[0]}/{part.column(1)[0]}".encode("utf-8", "replace")) % salts if part.num_rows else 0
            lists = [part.column(0).take(place), part.column(1).take(place), pa.array(tf, pa.int32()), pa.array(dl[at], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(len(terms), salt), pa.int32()), *(pa.ListArray.from_arrays(offsets, x) for x in lists)], names=["term", "salt", "source", "chunk_id", "tf", "dl"])

    grouped = chunks.select("source", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk_text").mapInArrow(group, schema)
    dealt = grouped.repartition("term", "salt").sortWithinPartitions("term")
    return dealt.select("term", F.inline(F.arrays_zip("source", "chunk_id", "tf", "dl"))).select("term", "source", "chunk_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def by_term(found: DataFrame, salts: int = 8) -> DataFrame:
    """Postings as they are stored: dealt by ranges of the term and sorted, so that few files hold a term; hot terms spread over ranges by source."""
    salt = F.pmod(F.xxhash64("source"), F.lit(salts))
    return found.repartitionByRange("term", salt).sortWithinPartitions("term")


def found_in_chunks(chunks: DataFrame, terms: list[str], analyzer: str = "bigram") -> DataFrame:
    """FOUND, by a scan of the chunks' texts.  ``terms``: sorted, of a block of queries, so few enough to be broadcast."""
    number = chunks.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    split = ANALYZERS[analyzer]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for part in _parts(batches):
            keep, lengths, offsets, at, tf = [], [], [0], [], []
            for k, text in enumerate(part.column(2).to_pylist()):
                mine = split(text or "")
                before = len(at)
                for term, n in Counter(mine).items():
                    i = get(term)
                    if i is not None:
                        at.append(i)
                        tf.append(n)
                if len(at) > before:
                    keep.append(k)
                    lengths.append(len(mine))
                    offsets.append(len(at))
            of = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(of, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)), pa.array(lengths, pa.int64()), *lists], names=["source", "chunk_id", "dl", "at", "tf"])

    return chunks.select("source", "chunk_id", "chunk_text").mapInArrow(count, FOUND)


def terms_in(index: DataFrame, terms: list[str]) -> DataFrame:
    """The terms' postings, with the term's number (``at``); few terms are pushed down to the files."""
    if len(terms) <= PUSHED_TERMS:
        index = index.filter(F.col("term").isin(terms))
    numbers = index.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, at int")
    return index.join(F.broadcast(numbers), "term")


def found_in_postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """FOUND, from postings: those of the terms alone are read and brought together by chunk."""
    mine = terms_in(index, terms)
    pairs = F.collect_list(F.struct("at", F.col("tf").cast("int").alias("tf")))
    rows = mine.groupBy("source", "chunk_id").agg(F.first("dl").alias("dl"), pairs.alias("p"))
    return rows.select("source", "chunk_id", "dl", F.col("p.at").alias("at"), F.col("p.tf").alias("tf"))


def corpus(chunks: DataFrame, analyzer: str = "bigram") -> DataFrame:
    """One row: n (chunks) and avgdl (terms per chunk); a null text has none."""
    low = F.coalesce(F.lower("chunk_text"), F.lit(""))
    if analyzer == "bigram":
        length = F.greatest(F.length(low) - 1, F.lit(0))
    else:
        length = F.regexp_count(low, F.lit(r"(?U)\w+"))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(length.cast("double")), F.lit(0.0)).alias("avgdl"))
