"""Full-text search over stored postings that passes over blocks which cannot reach the best hits.

Chunks are ordered by classes of length, then source, and cut into blocks, so that a
block's chunks are alike; a term's postings in a block are one row, with the greatest
term frequency and the least chunk length of that row.  BM25 grows with the one and
falls with the other, so these bound what the term gives any chunk of the block,
whatever the corpus' mean length is by then; summed over a query's terms they bound the
block.  Blocks of the greatest bounds are scored first; their last
of the best is a threshold, and only blocks whose bound reaches it are scored.  The
heads of the rows (term, block, bounds) are read for all blocks of the query's terms,
the positions and frequencies for those that are scored: pushed down to the files
where these are PUSHED_BLOCKS at most, else by a join.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.operators.index import ANALYZERS, PUSHED_TERMS
from shiori.operators.search import PLACES, ROWS, SCORED, Weights, best, blocks_of, ranked, terms_of
from shiori.sources.staging import release, remove, staged

#: Chunks of a block, and blocks of each query that are scored to find its threshold.
BLOCK, FIRST = 64, 4
#: So many blocks are pushed down to the files.
PUSHED_BLOCKS = 2_000
#: Blocks that are multiplied at once.
TOGETHER = 8
CHUNKS = "block long, source array<string>, chunk_id array<long>, dl array<long>"
POSTINGS = "term string, block long, n long, top_tf long, least_dl long, at array<int>, tf array<long>, dl array<long>"
#: Both, as they are cut: a row for each term of a block, and one without a term for its chunks, so that no row holds all terms of a block.
WHOLE = f"{POSTINGS}, source array<string>, chunk_id array<long>"


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType, of: np.ndarray | None = None) -> pa.ListArray:
    """Lists of those sizes; null where ``of`` is false."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(values, kind))
    return lists if of is None else pc.if_else(pa.array(of), lists, pa.scalar(None, lists.type))


def _rows(number: int, held: list[tuple], split: Callable[[str], list[str]]) -> pa.RecordBatch:
    """WHOLE, of one block of chunks (source, chunk_id, text)."""
    terms: dict[str, int] = {}
    which, at, tf, lengths = [], [], [], []
    for k, (_, _, text) in enumerate(held):
        found = split(text or "")
        lengths.append(len(found))
        counts = Counter(found)
        which += [terms.setdefault(t, len(terms)) for t in counts]
        tf += counts.values()
        at += [k] * len(counts)
    which, at, tf, dl = (np.array(x, np.int64) for x in (which, at, tf, lengths))
    order = np.argsort(which, kind="stable")
    at, tf = at[order], tf[order]
    n = np.bincount(which, minlength=len(terms))
    first = np.cumsum(n) - n
    # The chunks' row comes last: of no term, with the lengths of all.
    sizes, ends = np.append(n, 0), np.append(n, len(dl))
    top, least = (f.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, dl[at])))
    last = np.arange(len(n) + 1) == len(n)
    named = np.where(last, len(held), 0)
    columns = [
        pa.array([*terms, None], pa.string()), pa.array(np.full(len(last), number), pa.int64()), pa.array(np.append(n, len(held)), pa.int64()), pa.array(np.append(top, 0), pa.int64()), pa.array(np.append(least, 0), pa.int64()),
        _lists(sizes, at, pa.int32()), _lists(sizes, tf, pa.int64()), _lists(ends, np.concatenate((dl[at], dl)), pa.int64()),
        _lists(named, [h[0] for h in held], pa.string(), last), _lists(named, [h[1] for h in held], pa.int64(), last),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "top_tf", "least_dl", "at", "tf", "dl", "source", "chunk_id"])


def _in_blocks(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of the blocks, pushed down to the files where these are few; a join is to follow."""
    few = [r.block for r in blocks.select("block").distinct().limit(PUSHED_BLOCKS + 1).collect()]
    return table.filter(F.col("block").isin(few)) if len(few) <= PUSHED_BLOCKS else table


class BlockIndex:
    """An index in a folder: ``chunks`` (CHUNKS, a row a block), ``postings`` (POSTINGS, by ranges of the term)."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str = "bigram") -> None:
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer
        self.chunks = spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks")
        self.postings = spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, analyzer: str = "bigram", block: int = BLOCK, salts: int = 8) -> BlockIndex:
        """Writes the index of ``chunks`` (source, chunk_id, chunk_text) into a new folder; a null text has no terms.

        Blocks are numbered by partition and place, in a table that is written before
        anything is made of it, so that a repeated task cannot number them otherwise.
        """
        spark, path, split = chunks.sparkSession, path.rstrip("/"), ANALYZERS[analyzer]
        order = [F.floor(2 * F.log2(F.coalesce(F.length("chunk_text"), F.lit(0)) + 1)), F.col("source"), F.col("chunk_id")]
        ordered = chunks.select("source", "chunk_id", "chunk_text").repartitionByRange(*order).sortWithinPartitions(*order)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held = TaskContext.get().partitionId() << 33, []
            for batch in batches:
                for start in range(0, batch.num_rows, block):
                    for own in zip(*(c.to_pylist() for c in batch.slice(start, block).columns), strict=True):
                        held.append(own)
                        if len(held) == block:
                            yield _rows(number, held, split)
                            number, held = number + 1, []
            if held:
                yield _rows(number, held, split)

        whole = f"{path}/whole-{uuid.uuid4().hex}"
        ordered.mapInArrow(cut, WHOLE).write.parquet(whole)
        cuts = spark.read.schema(WHOLE).parquet(whole)
        cuts.filter("term is null").select("block", "source", "chunk_id", "dl").write.parquet(f"{path}/chunks")
        rows = cuts.filter("term is not null").drop("source", "chunk_id")
        rows.repartitionByRange("term", F.pmod(F.xxhash64("block"), F.lit(salts))).sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
        remove(spark, whole)
        return cls(spark, path, analyzer)

    def _corpus(self) -> tuple[int, float]:
        n, total = self.chunks.agg(F.coalesce(F.sum(F.size("dl")), F.lit(0)), F.coalesce(F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
        return n, total / n if n else 0.0

    def _of_terms(self, terms: list[str]) -> DataFrame:
        return self.postings.filter(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else self.postings

    def _weights(self, asked: list[tuple[int, int]], numbered: DataFrame, terms: int) -> Weights:
        known = {r.t: r.df for r in numbered.groupBy("t").agg(F.sum("n").alias("df")).collect()}
        return Weights(asked, terms, known, *self._corpus())

    @staticmethod
    def bounds(heads: DataFrame, shared, use, schema: str) -> DataFrame:
        """``use`` of (block numbers, bounds of queries x blocks) over ``heads`` (block, h: number of a term, greatest frequency, least length): no chunk of a block scores more."""

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    at, tf, dl = (c.to_numpy() for c in part.column(1).flatten().flatten())
                    row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                    yield use(part.column(0).to_numpy(), shared.value.product(part.num_rows, row, at, shared.value.parts(at, tf, dl)))

        return heads.mapInArrow(bound, schema)

    def scores(self, asks: DataFrame, numbers: DataFrame, terms: list[str], shared, least: np.ndarray, limit: int) -> DataFrame:
        """SCORED: the best of each block for the queries that ask for it.

        ``asks``: (block, queries: their places), written; ``numbers``: (term, t);
        scores are rounded, and those below ``least`` of the query are left out.
        """
        found = _in_blocks(self._of_terms(terms), asks).join(F.broadcast(numbers), "term").join(asks.select("block"), "block", "left_semi")
        # Lengths lie with the chunks; what is gathered by block is as narrow as can be.
        lists = found.groupBy("block").agg(F.collect_list(F.struct("t", "at", F.col("tf").cast("array<int>").alias("tf"))).alias("p"))
        rows = lists.join(asks, "block").join(_in_blocks(self.chunks, asks), "block")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(start, TOGETHER)
                    own, asking, source, chunk, dl = some.columns
                    sizes = source.value_lengths().to_numpy()
                    first = np.cumsum(sizes) - sizes
                    t, at, tf = own.flatten().flatten()
                    block = np.repeat(np.arange(some.num_rows), own.value_lengths().to_numpy())
                    many = at.value_lengths().to_numpy()
                    number, tf = np.repeat(t.to_numpy(), many), tf.flatten().to_numpy()
                    row = np.repeat(first[block], many) + at.flatten().to_numpy()
                    score = np.round(weights.product(sizes.sum(), row, number, weights.parts(number, tf, dl.flatten().to_numpy()[row])), PLACES)
                    asked = np.zeros((len(weights.ids), some.num_rows), bool)
                    asked[asking.flatten().to_numpy(), np.repeat(np.arange(some.num_rows), asking.value_lengths().to_numpy())] = True
                    part = pa.RecordBatch.from_arrays([source.flatten(), chunk.flatten()], names=["source", "chunk_id"])
                    yield best(weights.ids, np.where(np.repeat(asked, sizes, axis=1) & (score >= least[:, None]), score, 0.0), part, limit, 0.0)

        return rows.select("p", "queries", "source", "chunk_id", "dl").mapInArrow(near, SCORED)

    def top_k(self, queries: DataFrame, limit: int, first: int = FIRST, told: list | None = None) -> DataFrame:
        """(query_id, source, chunk_id, score, rank) of queries (query_id, query) by BM25 with OR semantics, as a scan of all chunks gives it.

        Queries of less than two characters, or null, find nothing.  Queries are taken
        in blocks; a block's weights and thresholds are on the driver.  ``told`` is
        given, for each of them, how many pairs of a query and a block have a bound and
        how many are scored.
        """
        asked = staged(queries.select(F.col("query_id").cast("long").alias("query_id"), terms_of(F.coalesce("query", F.lit("")), self.analyzer).alias("terms")), "asked")
        out = None
        for rows, only in blocks_of(asked, "terms"):
            terms = sorted({t for r in rows for t in r.terms})
            if not terms:
                continue
            number = {t: i for i, t in enumerate(terms)}
            numbers = self.spark.createDataFrame(list(number.items()), "term string, t int")
            numbered = self._of_terms(terms).select("term", "block", "n", "top_tf", "least_dl").join(F.broadcast(numbers), "term")
            weights = self._weights([(r.query_id, number[t]) for r in rows for t in r.terms], numbered, len(terms))
            shared, none = self.spark.sparkContext.broadcast(weights), np.zeros(len(weights.ids))
            heads = staged(numbered.groupBy("block").agg(F.collect_list(F.struct("t", "top_tf", "least_dl")).alias("h")), "heads")

            most = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
            tops = self.bounds(heads, shared, _greatest(first), "query int, block long, bound double").withColumn("k", F.row_number().over(most)).filter(F.col("k") <= first)
            seeds = staged(tops.groupBy("block").agg(F.collect_list("query").alias("queries")), "seeds")
            seen = ranked(self.scores(seeds, numbers, terms, shared, none, limit), limit).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            known = {r.query_id: r.least for r in seen.collect() if r.n == limit}
            least = np.array([known.get(i, 0.0) for i in weights.ids.tolist()])

            reached = staged(self.bounds(heads, shared, _reaching(least), "block long, bounded int, queries array<int>"), "reached")
            if told is not None:
                told.append(tuple(reached.agg(F.sum("bounded"), F.sum(F.size("queries"))).first()))
            asks = reached.filter(F.size("queries") > 0).select("block", "queries")
            one = ranked(self.scores(asks, numbers, terms, shared, least, limit), limit)
            release(heads, seeds)
            if not only:  # else the result is lazy, and reads the rest
                one = staged(one, "hits")
                release(reached)
            out = one if out is None else out.unionByName(one)
        release(asked)
        return self.spark.createDataFrame([], SCORED + ", rank int") if out is None else out


def _greatest(first: int):
    """Each query's blocks of the greatest bounds of a batch."""

    def use(blocks: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        j = np.argsort(-bound, axis=1, kind="stable")[:, :first]
        i = np.repeat(np.arange(len(bound)), j.shape[1])
        j = j.ravel()
        i, j = i[bound[i, j] > 0], j[bound[i, j] > 0]
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(blocks[j], pa.int64()), pa.array(bound[i, j])], names=["query", "block", "bound"])

    return use


def _reaching(least: np.ndarray):
    """Each block's queries whose threshold the bound reaches, and how many have a bound at all."""

    def use(blocks: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        j, i = np.nonzero(((bound > 0) & (bound * (1 + 1e-9) + 1e-9 >= least[:, None])).T)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(j, minlength=len(blocks)))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(i, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array((bound > 0).sum(0), pa.int32()), lists], names=["block", "bounded", "queries"])

    return use
