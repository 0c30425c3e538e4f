"""Shared plumbing: the cluster's shared folder, written tables, text batches."""

from __future__ import annotations

import contextlib
import math
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words in the word contracts: space and the ASCII controls 09-0D.
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Names that new_path makes.
_MADE = re.compile(r"^[a-z-]+-[0-9a-f]{32}$")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master gets a fresh temporary folder
    (tests); any other master is an error, as a machine-local folder would be
    invisible to the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shiori-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    true size of the table, so that it broadcasts only what it has measured.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables written inside each open scratch().
_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written inside it at its end, but for those handed to the function it gives.

    What is kept belongs to the scratch around this one, if there is one, and else
    to the caller of the operator, whose result is read from it.
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        release(*(t for t in own if all(t is not k for k in kept)))
        if _scopes:
            _scopes[-1].extend(kept)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again: all that hangs on them has itself been written."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path:
            fs, at = _folder(t.sparkSession, path)
            fs.delete(at, True)


def sweep(spark: SparkSession, older_than_seconds: float) -> int:
    """Deletes what operators have left in the shared folder for so long: tables behind results that callers hold lazily.

    Only names that :func:`new_path` makes are touched.  Call it when no job that
    began before that time is still running; no operator calls it.
    """
    fs, at = _folder(spark, shared_dir(spark))
    old = [s.getPath() for s in fs.listStatus(at) if _MADE.search(s.getPath().getName()) and s.getModificationTime() < (time.time() - older_than_seconds) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


#: Rows of a few numbers that are broadcast at most (some 40 MB in memory).
FEW_ROWS = 250_000


def few(df: DataFrame) -> DataFrame:
    """``df`` (a written table of narrow rows), to be broadcast if it is counted to have few; else it is shuffled as usual."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def unit_hash(seed: int, *cols: Column) -> Column:
    """A seeded 63-bit hash (non-negative long)."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def md5_hash(seed: int, *cols: Column) -> Column:
    """A seeded 63-bit hash that SQL engines share: the first 60 bits of an md5, shifted; null is its own value."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15)
    return F.shiftleft(F.conv(digits, 16, 10).cast("long"), 3)


def least_hashes(rows: DataFrame, group: list[str], bound: int) -> DataFrame:
    """(group, top): the ``bound``-th least distinct hash ``h`` of each group, or its last; a written table.

    No task holds a group: sketches of the distinct hashes are counted by ranges of
    the hash (64 to an octave), and only what lies below about twice the bound is
    then ranked.  Copies of a row count once.  ``group`` holds no nulls.
    """
    span = F.floor(64 * F.log2(F.col("h").cast("double") + 1))
    counted = rows.groupBy(*group, span.alias("_span")).agg(F.approx_count_distinct("h").alias("_n"), F.max("h").alias("_top"))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    rough = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < 2 * bound)
    rough = written(rough.groupBy(*group).agg(F.max("_top").alias("_rough")), "hash-ranges")
    near = rows.join(rough, group).filter(F.col("h") <= F.col("_rough")).select(*group, "h").distinct()
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).filter(F.col("_r") <= bound)
    return written(ranked.groupBy(*group).agg(F.max("h").alias("top")), "hash-bound")


def running(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: list[str],
    *,
    tie: list[str],
    first: str | None = None,
    rows_per_bucket: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``_n`` (rows before this one in its group) and ``_before_<c>`` (sum of c before it).

    A group may hold any share of the rows: rows are dealt by (group, bucket of
    the hash ``order``), numbered inside buckets, and shifted by the totals of
    the buckets before, so no task holds a whole group.  There are as many buckets
    as a bucket has rows (the root of their count, 512 rows at least), so neither
    a bucket nor a group's list of buckets grows beyond that.  ``order`` must be a
    63-bit hash; ``first`` (boolean) puts its rows before all others; ``tie``
    breaks ties of the hash.  ``df`` is read twice: pass a written table.
    """
    rows = df.count() if rows is None else rows
    rows_per_bucket = rows_per_bucket or max(512, math.isqrt(rows))
    buckets = max(1, -(-rows // rows_per_bucket))
    bucket = F.floor(F.col(order) / F.lit(2**63 / buckets)).cast("long")
    if first:
        bucket = bucket + F.when(F.col(first), 0).otherwise(buckets)
    df = df.withColumn("_bucket", bucket)
    key = [*group, "_bucket"]
    totals = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_tn"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(k).alias(f"_k_{k}") for k in key),
        F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_off_n"),
        *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums),
    )
    inside = Window.partitionBy(*key).orderBy(order, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {"_in_n": (F.row_number().over(inside) - 1).cast("long")}
        | {f"_in_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums}
    )
    met = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        met = same if met is None else met & same
    out = df.join(totals, met, "left")
    out = out.withColumns(
        {"_n": F.col("_in_n") + F.col("_off_n")} | {f"_before_{c}": F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in sums}
    )
    return out.drop("_bucket", "_in_n", "_off_n", *(f"_k_{k}" for k in key), *(f"_{p}_{c}" for c in sums for p in ("in", "off")))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pieces(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, in order."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def rank_from_zero(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Adds ``name``: the row's place in the whole table's order, from 0, without one task holding all rows.

    Rows are dealt by ranges of ``order``, numbered inside their range and shifted
    by the sizes of the ranges before (as many rows as shuffle partitions).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_range").orderBy(order)
    return dealt.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_in") + F.col("_off")).drop("_range", "_in", "_off")
