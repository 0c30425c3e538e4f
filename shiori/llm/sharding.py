"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a minimum
cost flow (staying costs nothing, a moved byte costs one unit) gives how many
bytes each old shard keeps and hands to each other shard: no plan moves fewer
bytes.  A block transfer is a run of an old shard's rows in hash order: what a
shard keeps comes first, and the rest of all old shards, one after the other, is
a line that the receiving shards share.  The runs' ends are found by prefix sums
over hash buckets and handed on as cut keys, so a row's new shard depends on
nothing but the row and the cuts, and only shards that give or get a block are
rewritten.

Law of the result: ``bytes``.  Rows above a 4096th of a shard's capacity come
first in their old shard's order, so that the cuts fall on small rows; shards
round their own cuts in turn down and up, so that the errors do not add up.

Edge cases: a null text has size 1 and the checksum of no bytes; null ids are
equal to each other; rows equal in id, size and checksum are numbered, so that a
cut may fall between them; an empty table gives no rows.  Input columns other than
those named are not read by :func:`reshard`; :func:`assign` replaces a column
``shard``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.llm.common import few, md5_hash, new_path, running, scratch, written

#: A row above this share of a shard's capacity counts as big.
BIG = 4096
SEED = 29


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Cheapest flow from supplies to demands of the same sum: successive shortest paths.

    Flow that costs nothing is fixed first; it is part of a cheapest flow where
    the other costs are one and the same, and may be pushed back where they are not.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(demand)
    for i in range(len(supply)):
        for j in range(len(demand)):
            if cost(i, j) == 0 and (x := min(left[i], room[j])):
                flow[i, j] = flow.get((i, j), 0) + x
                left[i] -= x
                room[j] -= x
    inf = float("inf")
    while any(left):
        # Bellman-Ford over the residual graph from all old shards that still have bytes.
        dist_o = [0 if x else inf for x in left]
        dist_n, from_n = [inf] * len(demand), [None] * len(demand)
        from_o: list = [None] * len(supply)
        changed = True
        while changed:
            changed = False
            for i, d in enumerate(dist_o):
                if d < inf:
                    for j in range(len(demand)):
                        if d + cost(i, j) < dist_n[j]:
                            dist_n[j], from_n[j], changed = d + cost(i, j), i, True
            for (i, j), x in flow.items():
                if x and dist_n[j] - cost(i, j) < dist_o[i]:
                    dist_o[i], from_o[i], changed = dist_n[j] - cost(i, j), j, True
        j = min((j for j in range(len(demand)) if room[j]), key=lambda j: dist_n[j])
        path, at, push = [], j, room[j]
        while True:
            i = from_n[at]
            path.append((i, at, 1))
            if from_o[i] is None:
                push = min(push, left[i])
                break
            at = from_o[i]
            path.append((i, at, -1))
            push = min(push, flow[i, at])
        left[i] -= push
        room[j] -= push
        for a, b, sign in path:
            flow[a, b] = flow.get((a, b), 0) + sign * push
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


#: What tells rows apart, in the order of an old shard after ``small`` and ``h``.
KEY = ("doc_id", "text_crc32", "size", "nth")


def row_facts(id_col: Column, text_col: Column) -> list[Column]:
    """doc_id, size and text_crc32 of a row."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text_col), F.lit(0)).cast("long")
    return [id_col.alias("doc_id"), size.alias("size"), crc.alias("text_crc32")]


def order_hash() -> Column:
    return md5_hash(SEED, F.col("doc_id"), F.col("text_crc32"), F.col("nth"))


def address() -> list[Column]:
    """Where a row of a Parquet data set lies: its file, and its place there."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``nth`` (how many equal rows come before, by file and place) and ``h`` to (doc_id, size, text_crc32, _file, _row, ...).

    Rows that nothing equals, as a count of hashes tells, are not shuffled again;
    of a repeated row, the copies are numbered file by file and shifted by the
    counts of the files before, so no task holds all copies.
    """
    key = ["doc_id", "text_crc32", "size"]
    rows = rows.withColumn("_k", F.xxhash64(*key))
    again = written(rows.groupBy("_k").count().filter("count > 1").select("_k"), "shard-again")
    if not again.head(1):
        return rows.drop("_k").withColumn("nth", F.lit(0).cast("long")).withColumn("h", order_hash())
    again = few(again)
    inside = Window.partitionBy("_k", *key, "_file")
    copies = rows.join(again, "_k", "left_semi").withColumn("_in", F.row_number().over(inside.orderBy("_row")) - 1)
    counts = rows.join(again, "_k", "left_semi").groupBy("_k", *key, "_file").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_k", *key).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"{c}2") for c in ("_k", *key, "_file")), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    same = (F.col("_k") == F.col("_k2")) & (F.col("_file") == F.col("_file2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("text_crc32") == F.col("text_crc322")) & (F.col("size") == F.col("size2"))
    copies = copies.join(counts, same).withColumn("nth", (F.col("_in") + F.col("_off")).cast("long"))
    alone = rows.join(again, "_k", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    return alone.unionByName(copies.select(*alone.columns)).drop("_k").withColumn("h", order_hash())


def plan(rows: DataFrame, n_old: int, capacities: Sequence[int] | int) -> tuple[dict, DataFrame]:
    """The flow {(old, new): bytes} and the cuts of ``rows`` (doc_id, size, text_crc32, nth, h, old_shard).

    ``capacities``: bytes of each new shard, or a number of equal ones.  The cuts
    are at most ``n_old`` rows of arrays with one entry per transfer: bounded by
    the number of shards, not by the data, so they are broadcast.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [sizes.get(i, 0) for i in range(n_old)]
    total = sum(supply)
    demand = even(total, capacities) if isinstance(capacities, int) else list(capacities)
    flow = min_cost_flow(supply, demand)
    limit = max(1, total // (max(1, len(demand)) * BIG))
    seen = running(rows.withColumn("big", F.col("size") > limit), ["old_shard"], "h", ["size"], tie=list(KEY), first="big", rows=rows.count())
    # A row stays if the point that its shard rounds at lies before the end of what stays.
    stay = F.element_at(F.array(*(F.lit(flow.get((i, i), 0)).cast("long") for i in range(n_old))), F.col("old_shard") + 1)
    point = F.col("_before_size") + F.col("size") * (F.lit(1.0) - (F.col("old_shard") + F.lit(0.5)) / F.lit(float(n_old)))
    seen = written(seen.withColumn("stays", point < stay), "shard-seen")
    kept = {r[0]: r[1] for r in seen.filter("stays").groupBy("old_shard").agg(F.sum("size")).collect()}
    tails = [supply[i] - kept.get(i, 0) for i in range(n_old)]
    # The tails' line, cut in proportion to what each receiving shard lacks.
    lacks = [(j, sum(x for (i, k), x in flow.items() if k == j != i)) for j in range(len(demand))]
    lacks = [(j, x) for j, x in lacks if x]
    needed, ends, top = sum(x for _, x in lacks), [], 0
    for _, x in lacks[:-1]:
        top += x
        ends.append(float(top) * sum(tails) / needed)
    shift = F.element_at(F.array(*(F.lit(sum(tails[:i]) - kept.get(i, 0)).cast("long") for i in range(n_old))), F.col("old_shard") + 1)
    middle = F.col("_before_size") + shift + F.col("size") / 2
    piece = F.size(F.filter(F.array(*(F.lit(e) for e in ends)).cast("array<double>"), lambda e: e <= middle))
    shards = F.array(*(F.lit(j) for j, _ in lacks or [(0, 0)]))
    placed = seen.withColumn("_to", F.when(F.col("stays"), F.col("old_shard")).otherwise(F.element_at(shards, piece + 1)).cast("int")).withColumn("_piece", F.when(F.col("stays"), -1).otherwise(piece))
    lows = placed.groupBy("old_shard", "_piece").agg(F.min(F.struct((~F.col("big")).alias("small"), "h", *KEY)).alias("low"), F.first("_to").alias("shard"))
    cuts = lows.groupBy(F.col("old_shard").alias("_old")).agg(F.sort_array(F.collect_list(F.struct("low", "shard"))).alias("cuts"))
    return flow, written(cuts.withColumn("limit", F.lit(limit)), "shard-cuts")


def assign(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``shard`` to rows that have doc_id, size, text_crc32, nth, h and old_shard."""
    rows = rows.drop("shard").join(F.broadcast(cuts), F.col("old_shard") == F.col("_old"))
    key = F.struct((F.col("size") <= F.col("limit")).alias("small"), "h", *KEY)
    return rows.withColumn("shard", F.element_at(F.filter("cuts", lambda c: c["low"] <= key), -1)["shard"]).drop("_old", "cuts", "limit")


def old_by_hash(n_old: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.shiftright(md5_hash(SEED + 1, F.col(id_col)), 3), F.lit(n_old)).cast("int")


def reshard(df: DataFrame, old_shard: Column, n_old: int, n_new: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, old_shard, shard, slot) of ``df`` resharded from n_old to n_new shards.

    Two passes over small rows, none over texts after the first; slots number a
    shard's rows from 0 without a gap, by prefix sums over hash buckets.
    """
    with scratch() as keep:
        facts = written(df.select(*row_facts(F.col(id_col), F.col(text_col)), old_shard.alias("old_shard")), "shard-facts")
        rows = written(numbered(facts.select("*", *address())).drop("_file", "_row"), "shard-rows")
        _, cuts = plan(rows, n_old, n_new)
        placed = keep(written(assign(rows, cuts), "shard-placed"))
    slotted = running(placed, ["shard"], "h", [], tie=list(KEY))
    return slotted.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("_n").alias("slot"))


def write_shards(df: DataFrame, shard: Column, path: str) -> None:
    """``df`` as a sharded data set: ``path/shard=i/``."""
    df.drop("shard").withColumn("shard", shard).write.partitionBy("shard").parquet(path)


def rewrite(spark, path: str, n_old: int, n_new: int, *, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> tuple[dict[int, list[str]], dict]:
    """Reshards the data set at ``path``; rewrites only shards that give or get a block.

    Returns a manifest {new shard: folders that hold its rows} and the flow.  A
    shard that keeps all its rows and gets none is named where it lies; the rest
    of the old shards are read once, and what each gives, keeps or gets is written
    under ``to`` (by default in the shared folder).
    """
    with scratch():
        docs = spark.read.option("basePath", path).parquet(path)
        facts = written(docs.select(*row_facts(F.col(id_col), F.col(text_col)), F.col("shard").alias("old_shard"), *address()), "shard-facts")
        rows = written(numbered(facts), "shard-rows")
        flow, cuts = plan(rows, n_old, n_new)
        touched = {i for i, j in flow if i != j} | {j for i, j in flow if i != j}
        still = [i for i in range(min(n_old, n_new)) if i not in touched and (i, i) in flow]
        to = to or new_path(spark, "resharded")
        moved = docs.filter(~F.col("shard").isin(still)) if still else docs
        moved = moved.select(F.struct(*(c for c in docs.columns if c != "shard")).alias("row"), *row_facts(F.col(id_col), F.col(text_col)), F.col("shard").alias("old_shard"), *address())
        # Numbers of repeated rows, by their place; most data sets have none.
        again = few(written(rows.filter("nth > 0").select("_file", "_row", "nth"), "shard-numbers"))
        moved = moved.join(again, ["_file", "_row"], "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long"))).withColumn("h", order_hash())
        assign(moved, cuts).select("row.*", "shard").write.partitionBy("shard").parquet(to)
    manifest = {i: [f"{path}/shard={i}"] for i in still}
    return manifest | {j: [f"{to}/shard={j}"] for j in range(n_new) if j not in still}, flow
