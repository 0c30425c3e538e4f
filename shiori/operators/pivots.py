"""Exact nearest vectors without scanning them all: a layout by pivots, and the triangle inequality.

Each vector lies in the cell of its nearest pivot, in files dealt by cell and distance
to the pivot (``radius``).  A vector within ``reach`` of a query has a radius that
differs from the query's own distance to that pivot by no more than ``reach``; cells
and parts of cells for which that cannot hold are passed over.  The reach is the
distance of the last of the best in the query's nearest cells, so it is never too
small, and the result is that of the full scan.

Where vectors do not cluster, little can be passed over and the work is that of
:func:`search.nearest` and one more look at the nearest cells; it is never another
result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.operators.search import PLACES, ROWS, SCORED, blocks_of, cut, distances, matrix, near_pairs, ranked, slack_of
from shiori.sources.staging import put, staged

#: Pivots, the vectors (of least hash) that they are fitted to, and rounds of the fit.
PIVOTS, SAMPLE, ROUNDS = 256, 8_192, 5
#: Ranges of radius that are pushed down to the files, at most; beyond, cells are.
PUSHED_RANGES = 64
LAID = "source string, chunk_id long, vector array<double>, cell int, radius double"


def fitted(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``pivots`` centres of a sample, by Lloyd's rounds from its first distinct rows."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(first)[:pivots]]
    for _ in range(rounds):
        home = distances(sample, centres).argmin(1)
        many = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centres)
    return centres


class Pivots:
    """A layout in a folder: ``vectors`` (LAID) and ``pivots.json`` (centre, rows, least and greatest radius of each cell, longest vector)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        told = json.loads("".join(r.value for r in spark.read.text(f"{self.path}/pivots.json").collect()))
        self.centres = np.array(told["centres"], np.float64)
        self.rows, self.low, self.high = (np.array(told[k]) for k in ("rows", "low", "high"))
        self.longest = told["longest"]

    @classmethod
    def lay_out(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS) -> Pivots:
        """Writes ``vectors`` (source, chunk_id, vector) into a new folder; rows without a vector have no place in it.

        Vectors are finite and of one length.  The pivots are fitted to SAMPLE rows; all
        rows are laid out.  Equal vectors lie in one cell, but over as many files as
        their rows ask for.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        given = vectors.filter("vector is not null").select("source", "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
        sample = given.select("vector").orderBy(F.xxhash64("vector", "source", "chunk_id")).limit(SAMPLE).toArrow()
        centres = fitted(matrix(sample.column(0).combine_chunks(), sample.num_rows), pivots) if sample.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2 * ROWS):
                    part = batch.slice(start, 2 * ROWS)
                    far = distances(matrix(part.column(2), part.num_rows), shared.value)
                    cell = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], names=["source", "chunk_id", "vector", "cell", "radius"])

        laid = given.mapInArrow(place, LAID)
        dealt = laid.repartitionByRange("cell", "radius", F.xxhash64("source", "chunk_id")).sortWithinPartitions("cell", "radius")
        dealt.write.parquet(f"{path}/vectors")
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        cells = {r.cell: r for r in spark.read.schema(LAID).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"), F.max(length).alias("longest")).collect()}
        used = [cells.get(c) for c in range(len(centres))]
        told = {"centres": centres.tolist(), "rows": [r.n if r else 0 for r in used], "low": [r.low if r else 0.0 for r in used], "high": [r.high if r else 0.0 for r in used], "longest": max((r.longest for r in cells.values()), default=0.0)}
        put(spark, f"{path}/pivots.json", json.dumps(told).encode())
        return cls(spark, path)

    def first_cells(self, far: np.ndarray, limit: int) -> np.ndarray:
        """Queries x cells: the nearest cells that hold ``limit`` rows together."""
        order = np.argsort(np.where(self.rows > 0, far, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        asked = np.zeros(far.shape, bool)
        np.put_along_axis(asked, order, held - self.rows[order] < limit, axis=1)
        return asked & (self.rows > 0)

    def in_reach(self, far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Queries x cells: those whose radii meet what the triangle inequality leaves."""
        wide = reach[:, None]
        return (self.rows > 0) & (far - wide <= self.high) & (far + wide >= self.low)

    def _wanted(self, far: np.ndarray, asked: np.ndarray, reach: np.ndarray) -> DataFrame:
        """The rows of cells that any query asks for, between the radii that any of them can use."""
        cells = np.flatnonzero(asked.any(0))
        laid = self.spark.read.schema(LAID).parquet(f"{self.path}/vectors")
        if len(cells) > PUSHED_RANGES:
            return laid.filter(F.col("cell").isin(cells.tolist()))
        low = np.where(asked, far - reach[:, None], np.inf).min(0)
        high = np.where(asked, far + reach[:, None], -np.inf).max(0)
        some = F.lit(False)
        for c in cells.tolist():
            some = some | ((F.col("cell") == c) & F.col("radius").between(max(float(low[c]), 0.0), min(float(high[c]), float(self.high[c]))))
        return laid.filter(some)

    def _look(self, ids: np.ndarray, q: np.ndarray, far: np.ndarray, asked: np.ndarray, reach: np.ndarray, limit: int, slack: float, products=None) -> DataFrame:
        """SCORED: rows that may be among the best ``limit`` of a query, in the cells it asks for and within its reach."""
        shared = self.spark.sparkContext.broadcast((ids, q, far, asked, reach))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, far, asked, reach = shared.value
            for batch in batches:
                cells = batch.column(3).to_numpy()
                cuts = np.flatnonzero(np.diff(cells)) + 1
                for start, stop in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                    for at in range(start, stop, 2 * ROWS):
                        part = batch.slice(at, min(2 * ROWS, stop - at))
                        radius, c = part.column(4).to_numpy(), cells[at]
                        own = np.flatnonzero(asked[:, c] & (far[:, c] - reach <= radius.max()) & (far[:, c] + reach >= radius.min()))
                        if len(own):
                            if products is not None:
                                products.add(len(own) * part.num_rows)
                            i, j, apart = near_pairs(q[own], matrix(part.column(2), part.num_rows), limit, reach[own], slack)
                            yield cut(ids[own], i, j, -np.round(apart, PLACES), part, limit)

        wanted = self._wanted(far, asked, reach).select("source", "chunk_id", "vector", "cell", "radius")
        return wanted.mapInArrow(near, SCORED)

    def nearest(self, queries: DataFrame, limit: int, products=None) -> DataFrame:
        """(query_id, source, chunk_id, score = -distance, rank) of a table of queries (query_id, vector), over all rows.

        Queries are taken in blocks; a block's vectors and reaches are on the driver.
        Queries without a vector find nothing, nor does any query in an empty layout.
        ``products``: an accumulator that is told how many distances were computed.
        """
        out = None
        for rows, only in blocks_of(queries.filter("vector is not null")):
            ids, q = np.array([r.query_id for r in rows], np.int64), np.array([r.vector for r in rows], np.float64)
            if not len(self.centres):
                continue
            far = distances(q, self.centres)
            slack = slack_of(q, self.longest)
            first = self._look(ids, q, far, self.first_cells(far, limit), np.full(len(ids), np.inf), limit, slack, products)
            last = {r.query_id: r for r in ranked(first, limit).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(-F.col("score")).alias("far")).collect()}
            reach = np.array([last[i].far + 2 * slack if i in last and last[i].n == limit else np.inf for i in ids.tolist()])
            one = ranked(self._look(ids, q, far, self.in_reach(far, reach), reach, limit, slack, products), limit)
            one = one if only else staged(one, "nearest")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], SCORED + ", rank int") if out is None else out
