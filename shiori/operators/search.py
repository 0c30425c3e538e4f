"""Hybrid search: a BM25 leg and an exact vector leg, fused by reciprocal rank.

Every function takes a table of queries (query_id, query) and answers all of
them; a single search is a table of one row.  Queries are taken in blocks that
are small enough to be broadcast; only a block's terms and vectors are on the
driver at a time.  Both legs multiply Arrow batches of chunks with a block of
queries and keep a batch's best rows of each query, so that a shuffle carries
batches x queries x limit rows, never a row for each chunk and query that meet.

Ties are broken by score, then source, then chunk_id; scores are rounded to nine
places before they are ranked, so that the order of a sum cannot decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.operators.chunking import by_parts
from shiori.operators.embedding import embed
from shiori.operators.index import ANALYZERS, found_in_chunks, found_in_postings, terms_in
from shiori.sources.staging import release, staged

#: Okapi BM25.
K1, B = 1.2, 0.75
#: A query shorter than this (code points, not trimmed) has no full-text leg.
MIN_QUERY = 2
#: Queries of a block, and their terms, about; rows of chunks that are multiplied at once.
QUERY_BLOCK, TERMS_BLOCK, ROWS = 4096, 200_000, 512
#: Entries of a dense matrix at most, and pairs that are listed at once.
DENSE, LISTED = 1 << 22, 1 << 22
#: Postings that cost as much to bring together by chunk as the chunk's text to be read and counted.
SCAN = 32
KEYWORD, SEMANTIC = 1, 2
PLACES = 9
#: Of a distance that is computed by products, against rounding: a share of the longest vector.
SLACK = 1e-6


def rrf(rank: Column, k: int) -> Column:
    """1 / (k + rank + 1), rank from 0."""
    return F.lit(1.0) / (F.lit(k) + rank + 1)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query with ``rank`` from 0."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def terms_of(query: Column, analyzer: str = "bigram") -> Column:
    """``array<string>``: distinct terms of a query that is long enough."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return by_parts(texts, lambda part: pa.array([sorted(set(ANALYZERS[analyzer](t))) if t is not None else [] for t in part], pa.list_(pa.string())))

    return F.when(F.length(query) >= MIN_QUERY, split(query)).otherwise(F.array().cast("array<string>"))


def cut(ids: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, part: pa.RecordBatch, limit: int) -> pa.RecordBatch:
    """SCORED, of pairs of a query (place ``i`` in ``ids``) and a row ``j`` of the batch: each query's best ``limit``, ties in order of source and chunk."""
    many = np.bincount(i, minlength=len(ids))
    if len(i) and many.max() > limit:
        named = pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["s", "c"])
        place = np.empty(part.num_rows, np.int64)
        place[pc.sort_indices(named, [("s", "ascending"), ("c", "ascending")]).to_numpy()] = np.arange(part.num_rows)
        order = np.lexsort((place[j], -score, i))
        order = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) < limit]
        i, j, score = i[order], j[order], score[order]
    return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), part.column(0).take(pa.array(j)), part.column(1).take(pa.array(j)), pa.array(score)], names=["query_id", "source", "chunk_id", "score"])


def best(ids: np.ndarray, score: np.ndarray, part: pa.RecordBatch, limit: int, above: float = -np.inf) -> pa.RecordBatch:
    """Of a batch's scores (queries x rows): each query's best ``limit``."""
    keep = min(limit, score.shape[1])
    least = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
    i, j = np.nonzero((score >= least[:, None]) & (score > above))
    return cut(ids, i, j, score[i, j], part, limit)


SCORED = "query_id long, source string, chunk_id long, score double"


class Weights:
    """A block's queries by term: inverse document frequencies, and the queries that hold each term."""

    def __init__(self, asked: list[tuple[int, int]], n_terms: int, df: dict[int, int], n: int, avgdl: float) -> None:
        pairs = np.array(sorted((t, q) for q, t in asked), np.int64).reshape(-1, 2)
        self.ids, self.query = np.unique(pairs[:, 1], return_inverse=True)
        self.many = np.bincount(pairs[:, 0], minlength=n_terms)
        self.start = np.cumsum(self.many) - self.many
        known = np.array([df.get(t, 0) for t in range(n_terms)], np.float64)
        self.idf = np.log(1 + (n - known + 0.5) / (known + 0.5))
        self.avgdl = max(avgdl, 1e-12)

    def score(self, dl: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """BM25 of queries x rows, of rows of ``sizes`` terms each."""
        row = np.repeat(np.arange(len(dl)), sizes)
        return self.product(len(dl), row, at, self.parts(at, tf, dl[row]))

    def parts(self, at: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """What a term gives a row in which it stands ``tf`` times, of length ``dl``."""
        return self.idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))

    def product(self, rows: int, row: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Queries x rows: the product of the rows' terms (``part`` at ``row`` and term ``at``) and the queries' sparse terms."""
        queries = len(self.ids)
        used, where = np.unique(at, return_inverse=True)
        if max(rows, queries) * len(used) <= DENSE:
            a, b = np.zeros((len(used), rows)), np.zeros((len(used), queries))
            a[where, row] = part
            number = np.repeat(np.arange(len(used)), self.many[used])
            b[number, self.query[self._places(used)]] = 1
            return b.T @ a
        out = np.zeros(queries * rows)
        upto = np.cumsum(self.many[at])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LISTED, side="right")))
            own = at[start:stop]
            n = self.many[own]
            out += np.bincount(self.query[self._places(own)] * rows + np.repeat(row[start:stop], n), np.repeat(part[start:stop], n), queries * rows)
            start = stop
        return out.reshape(queries, rows)

    def _places(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms' queries stand, term by term."""
        n = self.many[terms]
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[terms], n)


def full_text_leg(found: DataFrame, corpus: DataFrame, terms: list[str], asked: list[tuple[int, int]], limit: int) -> DataFrame:
    """(query_id, source, chunk_id, score, rank) by BM25 with OR semantics.

    ``found``: the chunks that hold any of a block's ``terms`` (index.FOUND; read
    twice, so staged or cheap); ``corpus``: one row (n, avgdl); ``asked``: (query,
    number of its term).  A row for each term is all that the driver gets.
    """
    spark = found.sparkSession
    frequency = {r[0]: r[1] for r in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1))).collect()}
    shared = spark.sparkContext.broadcast(Weights(asked, len(terms), frequency, *corpus.select("n", "avgdl").first()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column(3)
                sizes = lists.value_lengths().to_numpy()
                score = shared.value.score(part.column(2).to_numpy(), sizes, lists.flatten().to_numpy(), part.column(4).flatten().to_numpy())
                yield best(shared.value.ids, np.round(score, PLACES), part, limit, 0.0)

    return ranked(found.mapInArrow(near, SCORED), limit)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def slack_of(q: np.ndarray, longest: float) -> float:
    """By how much :func:`distances` may be off for vectors up to that length."""
    return SLACK * (1 + longest + float(np.sqrt((q * q).sum(1)).max()))


def near_pairs(q: np.ndarray, v: np.ndarray, limit: int, reach: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a vector that may be among its nearest ``limit``, with distances of their differences, so that equal vectors are equally far."""
    about = distances(q, v)
    keep = min(limit, len(v))
    last = np.partition(about, keep - 1, axis=1)[:, keep - 1]
    i, j = np.nonzero(about <= np.minimum(last + 2 * slack, reach)[:, None])
    far = np.empty(len(i))
    for start in range(0, len(i), 16 * ROWS):
        own = slice(start, start + 16 * ROWS)
        far[own] = np.sqrt(((q[i[own]] - v[j[own]]) ** 2).sum(1))
    return i, j, far


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def vector_leg(chunks: DataFrame, ids: np.ndarray, vectors: np.ndarray, limit: int, vector: str = "vector") -> DataFrame:
    """Exact nearest chunks by L2 distance to a block of query vectors: (query_id, source, chunk_id, score = -distance, rank)."""
    shared = chunks.sparkSession.sparkContext.broadcast((ids, vectors.astype(np.float64)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2 * ROWS):
                part = batch.slice(start, 2 * ROWS)
                v = matrix(part.column(2), part.num_rows)
                i, j, far = near_pairs(q, v, limit, np.full(len(ids), np.inf), slack_of(q, float(np.sqrt((v * v).sum(1).max()))))
                yield cut(ids, i, j, -np.round(far, PLACES), part, limit)

    return ranked(chunks.select("source", "chunk_id", vector).mapInArrow(near, SCORED), limit)


def blocks_of(queries: DataFrame, terms: str | None = None) -> Iterator[tuple[list, bool]]:
    """The rows of ``queries`` (with query_id) in blocks, one on the driver at a time, and whether it is the only one."""
    size = F.coalesce(F.sum(F.size(terms)), F.lit(0)) if terms else F.lit(0)
    n, total = queries.agg(F.count(F.lit(1)), size).first()
    count = max(1, -(-n // QUERY_BLOCK), -(-total // TERMS_BLOCK))
    for k in range(count):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == k).collect()
        if rows:
            yield rows, count == 1


def nearest(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The vector leg of a whole table of queries (query_id, vector)."""
    out = None
    for rows, only in blocks_of(queries):
        one = vector_leg(chunks, np.array([r.query_id for r in rows]), np.array([r.vector for r in rows], np.float64), limit)
        one = one if only else staged(one, "nearest")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no query")
    return out


def fuse(legs: list[tuple[int, DataFrame]], limit: int, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked legs: (query_id, source, chunk_id, score, method, rank)."""
    union = None
    for mark, leg in legs:
        one = leg.select("query_id", "source", "chunk_id", rrf(F.col("rank"), k).alias("part"), F.lit(mark).alias("leg"))
        union = one if union is None else union.unionByName(one)
    fused = union.groupBy("query_id", "source", "chunk_id").agg(F.sum("part").alias("score"), F.bit_or("leg").alias("legs"))
    method = F.when(F.col("legs") == KEYWORD | SEMANTIC, "Hybrid").when(F.col("legs") == KEYWORD, "Keyword").otherwise("Semantic")
    return ranked(fused.select("query_id", "source", "chunk_id", "score", method.alias("method")), limit)


def with_context(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Adds ``text``: the chunks up to ``window`` around each hit, joined by newlines.

    Hits are at most ``limit`` per query, but queries may be many: the planner decides how to join.
    """
    near = chunks.select(F.col("source").alias("_s"), F.col("chunk_id").alias("_c"), "chunk_text")
    low, high = F.greatest(F.col("chunk_id") - window, F.lit(0)), F.col("chunk_id") + window
    wide = hits.withColumn("_c2", F.explode(F.sequence(low, high)))
    joined = wide.join(near, (F.col("source") == F.col("_s")) & (F.col("_c2") == F.col("_c")))
    parts = F.sort_array(F.collect_list(F.struct("_c", "chunk_text")))
    return joined.groupBy(*hits.columns).agg(F.array_join(F.transform(parts, lambda p: p["chunk_text"]), "\n").alias("text"))


#: Chunks of a block of one source.
CONTEXT_BLOCK = 1024


def all_contexts(chunks: DataFrame, window: int, block: int = CONTEXT_BLOCK) -> DataFrame:
    """(source, chunk_id, text): :func:`with_context` of every chunk, by one exchange.

    Chunks are dealt by source and block of ids, those near an edge to the next block
    too, and a range frame gathers each one's neighbours; no task holds a long source.
    Chunk ids differ within a source; a null text is passed over.
    """
    home = F.floor(F.col("chunk_id") / block).cast("long")
    near = F.array_distinct(F.transform(F.array(F.lit(-window), F.lit(0), F.lit(window)), lambda d: F.floor((F.col("chunk_id") + d) / block).cast("long")))
    dealt = chunks.select("source", "chunk_id", "chunk_text", F.explode(near if window <= block else F.sequence(home - window // block - 1, home + window // block + 1)).alias("block"))
    frame = Window.partitionBy("source", "block").orderBy("chunk_id").rangeBetween(-window, window)
    told = dealt.withColumn("text", F.array_join(F.collect_list("chunk_text").over(frame), "\n"))
    return told.filter(F.col("block") == home).select("source", "chunk_id", "text")


def _saves(index: DataFrame, terms: list[str], corpus: DataFrame) -> bool:
    """Whether the terms' postings are so few that bringing them together costs less than a look at the texts."""
    return terms_in(index, terms).count() <= SCAN * corpus.select("n").first()[0]


def hybrid(chunks: DataFrame, corpus: DataFrame, queries: DataFrame, embedder, *, index: DataFrame | None = None, limit: int = 5, k: int = 60, window: int = 1, analyzer: str = "bigram", kind: str = "float") -> DataFrame:
    """Both legs cut at ``limit``, fused, cut again, with neighbouring text.

    ``chunks``: source, chunk_id, chunk_text, vector.  ``index``: their postings;
    without them, or where those of a block's terms are more than SCAN a chunk, the
    chunks' texts are scanned for the queries' terms, once for a block of queries.  Vectors and terms of the queries are made by the executors.
    """
    told = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("query", F.lit("")).alias("query"))
    told = staged(told.withColumn("vector", embed(F.col("query"), embedder, kind)).withColumn("terms", terms_of(F.col("query"), analyzer)), "queries")
    out = None
    for rows, only in blocks_of(told, "terms"):
        terms = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        asked = [(r.query_id, number[t]) for r in rows for t in r.terms]
        legs = [(SEMANTIC, vector_leg(chunks, np.array([r.query_id for r in rows]), np.array([r.vector for r in rows], np.float64), limit))]
        if terms:
            found = staged(found_in_postings(index, terms) if index is not None and _saves(index, terms, corpus) else found_in_chunks(chunks, terms, analyzer), "found")
            legs.append((KEYWORD, full_text_leg(found, corpus, terms, asked, limit)))
        one = with_context(fuse(legs, limit, k), chunks, window)
        if not only:  # else the result is lazy, and reads what was found
            one = staged(one, "hits")
            if terms:
                release(found)
        out = one if out is None else out.unionByName(one)
    release(told)
    if out is None:
        raise ValueError("no query")
    return out
