"""Connected components of an edge table, by large-star and small-star steps.

Edge cases: loops and repeated edges change nothing; an edge with a null end is
dropped, as it names no node; an empty table gives no rows.  Columns other than
``a`` and ``b`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import written


EDGES_PER_FILE = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, root): each node that is not its component's least, with the least.

    Each round is joins and aggregations over written tables; nothing but two
    numbers per round reaches the driver, and no task holds a component: the
    joins are splittable by Spark's skew join, the aggregates combine map-side.
    """
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = written(now, "edges"), None
    # Files by the number of edges, which no round increases by more than its nodes.
    files = max(1, now.count() // EDGES_PER_FILE)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("c")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.coalesce(files), "edges")
        root = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        small = large.join(root, F.col("a") == F.col("c"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = written(small.coalesce(files), "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = found
