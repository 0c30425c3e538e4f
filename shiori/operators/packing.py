"""Packing of rows into chunks in parallel, by pointer jumping.

Greedy packing is a chain: where a chunk ends, the next begins, and a group may hold
any share of all rows.  Let a line's position be the lengths of the lines before it in
its group, with a newline each; then a chunk that begins at a position ends at the
last line end within ``size`` of it, whatever came before.  So

* lines are dealt by ranges of group and order, and get their positions by sums over
  ranges; a group's positions are cut into blocks of equal length;
* each block tells, for every line that a chunk from before it can lead to, at which
  position beyond the block the chain goes on, and how many chunks begin meanwhile;
* these jumps are doubled (two jumps are one of the next round) until no chain is
  long enough, and marked from the groups' beginnings on, which takes as many rounds
  as the logarithm of the most blocks of a group; rows of three numbers are joined;
* each block packs its lines from its marked beginning on.  It also has the lines of
  the next block that its last chunk may reach.

No task holds more than a block of lines (``block`` characters) or one line.

Edge cases: null lines are passed over; a null key is a group of its own; rows of
equal group and order come in any order; an empty line is a line; a line longer than
``size`` is a chunk of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.schema import CHUNK_SIZE
from shiori.sources.staging import release, staged

#: Characters of a block.
BLOCK = 1 << 20


def pack_rows(df: DataFrame, keys: list[str], order: str, text: str, size: int = CHUNK_SIZE, *, block: int = BLOCK) -> DataFrame:
    """Each group's lines in order, packed into chunks of at most ``size`` characters (keys, chunk_id, chunk_text)."""
    block = max(block, 2 * (size + 1))
    own = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True)), F.col(order).alias("o"), F.col(text).alias("t")).filter("t is not null")
    lines = staged(positions_in_ranges(rows, own), "pack-lines")
    totals = lines.groupBy(*own, "part").agg(F.max(F.col("s") + F.col("n") + 1).alias("units"))
    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(totals.select(*own, "part", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("off")), "pack-offsets")
    placed = met(lines, offsets, [*own, "part"]).withColumn("s", F.col("s") + F.col("off")).drop("part", "off")
    home = F.floor(F.col("s") / block).cast("long")
    # A line that a chunk of the block before may reach goes there too.
    reached = (home > 0) & (F.col("s") - home * block <= size)
    dealt = placed.withColumn("b", F.explode(F.when(reached, F.array(home, home - 1)).otherwise(F.array(home))))
    begins = beginnings(dealt.drop("t"), offsets, own, size, block)
    mine = met(dealt, begins.withColumn("b", F.floor(F.col("begin") / block).cast("long")), [*own, "b"])
    schema = df.select(*(F.col(k).alias(n) for k, n in zip(keys, own, strict=True))).schema.add("chunk_id", "long").add("chunk_text", "string")
    mine = mine.select(*own, "b", "s", "n", "begin", "number", "t").repartition(*own, "b").sortWithinPartitions(*own, "b", "s")
    packed = mine.mapInArrow(_packing(len(own), size, block, schema.fieldNames()), schema)
    return packed.select(*(F.col(n).alias(k) for k, n in zip(keys, own, strict=True)), "chunk_id", "chunk_text")


def same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def met(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``other`` where ``on`` are equal, nulls too."""
    told = other.select(*(F.col(c).alias(f"r_{c}") for c in on), *(c for c in other.columns if c not in on))
    return rows.join(told, same([F.col(c) for c in on], [F.col(f"r_{c}") for c in on]), how).drop(*(f"r_{c}" for c in on))


def positions_in_ranges(rows: DataFrame, own: list[str]) -> DataFrame:
    """Rows dealt by ranges: the keys, the range ``part``, the position ``s`` in what the range has of the group, the length ``n`` and ``t``."""
    dealt = rows.repartitionByRange(*own, "o").sortWithinPartitions(*own, "o").drop("o")
    schema = rows.select(*own).schema.add("part", "integer").add("s", "long").add("n", "long").add("t", "string")
    names, k = schema.fieldNames(), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = [len(t) for t in batch.column(k).to_pylist()]
            places = []
            for key, n in zip(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True) if k else [()] * len(lengths), lengths, strict=True):
                if key != group:
                    group, at = key, 0
                places.append(at)
                at += n + 1
            more = [pa.array([part] * len(lengths), pa.int32()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *more], names=names)

    return dealt.mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of equal first ``k`` columns, batch by batch: the key, and some rows of it."""
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i


def jumps(places: np.ndarray, lengths: np.ndarray, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's lines (positions from ``low`` to ``high``, and those behind): where a chain from some leaves it, and with how many chunks.

    Returned for those lines of the block that a chunk from before it can lead to.
    """
    ends = places + lengths + 1
    mine = int(np.searchsorted(places, high))
    last = np.maximum(np.searchsorted(ends, places[:mine] + size + 1, side="right") - 1, np.arange(mine))
    to, count = ends[last].tolist(), [1] * mine
    for i, j in zip(range(mine - 1, -1, -1), (last[::-1] + 1).tolist(), strict=True):
        if j < mine:
            to[i], count[i] = to[j], count[j] + 1
    asked = np.flatnonzero((places[:mine] - low <= size) | (np.arange(mine) == 0))
    return places[asked], np.array(to, np.int64)[asked], np.array(count, np.int64)[asked]


def beginnings(dealt: DataFrame, offsets: DataFrame, own: list[str], size: int, block: int) -> DataFrame:
    """(keys, begin, number): of each block that a chunk begins in, the first such position and chunk; a staged table."""
    schema = dealt.select(*own).schema.add("s", "long").add("to", "long").add("chunks", "long")
    k, names, kinds = len(own), schema.fieldNames(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                s, n = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("s", "n"))
                low = key[-1] * block
                found = jumps(s, n, low, low + block, size)
                if len(found[0]):
                    group = [pa.array([v] * len(found[0]), held[0].schema.field(i).type) for i, v in enumerate(key[:-1])]
                    yield pa.RecordBatch.from_arrays([*group, *map(pa.array, found)], names=names)
                held.clear()

        for now, some in blocks(batches, k + 1):
            if now != key:
                yield from flush()
                key = now
            held.append(some)
        yield from flush()

    told = dealt.select(*own, "b", "s", "n").repartition(*own, "b").sortWithinPartitions(*own, "b", "s")
    levels = [staged(told.mapInArrow(run, schema), "pack-jumps")]
    while True:
        further = levels[-1].select(*own, F.col("s").alias("to"), F.col("to").alias("_to"), F.col("chunks").alias("_chunks"))
        twice = met(levels[-1], further, [*own, "to"]).select(*own, "s", F.col("_to").alias("to"), (F.col("chunks") + F.col("_chunks")).alias("chunks"))
        twice = staged(twice, "pack-jumps")
        if not twice.head(1):
            release(twice)
            break
        levels.append(twice)
    marks = offsets.filter("off = 0").select(*own, F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("number")).distinct()
    tables = []
    for level in reversed(levels):
        onward = met(marks, level, [*own, "s"]).select(*own, F.col("to").alias("s"), (F.col("number") + F.col("chunks")).alias("number"))
        marks = staged(marks.unionByName(onward), "pack-marks")
        tables.append(marks)
    # A chain ends at a position that no line has.
    out = staged(met(marks, levels[0].select(*own, "s"), [*own, "s"], "left_semi").select(*own, F.col("s").alias("begin"), "number"), "pack-begins")
    release(*levels, *tables)
    return out


def _packing(k: int, size: int, block: int, names: list[str]):
    """For sorted rows (keys, b, s, n, begin, number, t): the chunks that begin in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, length, number, over = None, [], 0, 0, True
        kinds, done = None, []

        def close() -> None:
            if lines:
                done.append((*key[:-1], number, "\n".join(lines)))
                lines.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*kinds, pa.int64(), pa.string()], strict=True)], names=names)
            done.clear()
            return out

        for now, some in blocks(batches, k + 1):
            kinds = [some.schema.field(i).type for i in range(k)]
            if now != key:
                close()
                key, over, number = now, False, some.column("number")[0].as_py() - 1
            high, begin = (now[-1] + 1) * block, some.column("begin")[0].as_py()
            for s, n, t in zip(*(some.column(c).to_pylist() for c in ("s", "n", "t")), strict=True):
                if over or s < begin:
                    continue
                if lines and length + 1 + n <= size:
                    lines.append(t)
                    length += 1 + n
                    continue
                close()
                if s >= high:
                    over = True
                    continue
                number, length = number + 1, n
                lines.append(t)
            if len(done) >= 1024:
                yield flush()
        close()
        if done:
            yield flush()

    return run
