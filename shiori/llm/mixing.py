"""Mixing sources to target weights by capped water-filling.

Targets: the level L at which sum(min(weight * L, cap)) is the wanted total; a
source whose share would exceed its cap (a number of epochs) is clamped, and the
excess is reshared by weight among the others until none is above.

Sampling: a source is repeated whole floor(target / size) times; the rest is a
fractional repetition: its documents in the order of a seeded hash, up to the
word at which the target is met, so at most one document per source is itself
taken in part, and a source's taken words miss its target by less than one word.

No task holds a source: the fractional repetition is found by prefix sums over
hash buckets, and is handed on as one cut (hash, id, size) per source.  Rows that
are equal in all three are numbered, by the partition that read them and their
place there, and the cut falls between them; only rows of cut keys are.

Edge cases: null sources are a source of their own, last in order; a null or
blank text has size 0 and is taken 0 times; a source of size 0 has target 0;
of rows with equal id and size the first are taken; an empty table gives an empty
mix.  Columns of the input keep their names, whatever they are, but ``copy`` and
``partial`` of :func:`mix` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.llm.common import WORD_RE, few, md5_hash, rank_from_zero, running, scratch, written


@dataclass(frozen=True)
class MixSpec:
    #: Weights of the sources in order, repeating.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: The mix's size as a share of all sizes.
    share: float = 1.5
    #: Most repetitions of a source.
    epochs: float = 2.0
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: capped water-filling.

    A round is one aggregation that returns one row; each clamps further sources,
    until the level stands.
    """
    ranked = rank_from_zero(sources, F.asc_nulls_last("source"), "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in spec.weights)), (F.col("_rank") % len(spec.weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(spec.epochs)).alias("_cap")), "mix-sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * spec.share
    level, clamped = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) > F.col("_cap") if clamped >= 0 else F.lit(False)
        n, caps, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if n == clamped or not free:
            break
        level, clamped = (total - caps) / free, n
    return table.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(doc_id, source, size, h) of every row, and its ``place`` (partition, row), which stands once the rows are written."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return rows.withColumn("h", md5_hash(seed, F.col("doc_id"), F.col("size"))).withColumn("place", place())


def place() -> Column:
    return F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))


def shared_out(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (a written table with ``size``, ``need`` and ``place``) with ``words``: ``need`` words of each group, row by row.

    A row's number in its group is its number among those of its partition, and the
    counts of the partitions before.
    """
    part = F.col("place.part").alias("_part")
    counts = rows.groupBy(F.col(group).alias("_g"), part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = few(written(counts.select("_g", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "mix-counts"))
    inside = F.row_number().over(Window.partitionBy(group, "place.part").orderBy("place.row")) - 1
    met = rows.withColumn("_in", inside).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("place.part") == F.col("_part")))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("size") * (F.col("_in") + F.col("_off"))))
    return met.withColumn("words", words.cast("long")).drop("_g", "_part", "_off", "_in")


def plan(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut (hash, id, size of the key at which the rest ends), need (words of its rows together)."""
    with scratch() as keep:
        sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), spec)
        sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        sources = written(sources.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-targets")
        keys = rows.groupBy("source", "h", "doc_id", "size").agg(F.sum("size").alias("words"))
        seen = running(keys, ["source"], "h", ["words"], tie=["doc_id", "size"], rows=rows.count())
        rest = few(sources.select(F.col("source").alias("_s"), "rest"))
        crossing = seen.join(rest, F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("_before_words") <= F.col("rest")) & (F.col("rest") < F.col("_before_words") + F.col("words")))
        cut = crossing.select("_s", F.struct("h", "doc_id", "size").alias("cut"), (F.col("rest") - F.col("_before_words")).alias("need"))
        return keep(written(sources.join(few(written(cut, "mix-cuts")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest"), "mix-plan"))


def with_part(rows: DataFrame, near: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """Adds ``whole`` (repetitions), ``part`` (words of a last, fractional one), source_size and target to rows with doc_id, source, size, h and place.

    Rows of a cut key are set aside in a table, where their numbers stand; ``near``
    are the rows that have the ids of the cuts, or more.
    """
    told = few(plan.withColumnRenamed("source", "_s"))
    key = F.struct("h", "doc_id", "size")
    at_cut = F.coalesce(key == F.col("cut"), F.lit(False)) & (F.col("size") > 0)
    part = F.when(key < F.col("cut"), F.col("size")).otherwise(0).cast("long")

    def met(some: DataFrame) -> DataFrame:
        return some.join(told, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    plain = met(rows).filter(~at_cut).withColumn("part", part)
    cut = shared_out(written(met(near).filter(at_cut), name), "source").withColumnRenamed("words", "part")
    return plain.unionByName(cut).drop("cut", "need")


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, whole (repetitions), part (words of a last, fractional one) and taken (words) to a written table of sizes."""
    return with_part(rows, rows, plan, "mix-cut-sizes").withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop("place")


def mix(df: DataFrame, spec: MixSpec = MixSpec(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df`` as often as taken, with ``copy`` (from 1) and ``partial`` (the text is cut at a word).

    The plan has one row per source; it is broadcast if it is counted to have few,
    and else joined, where Spark splits hot sources by its skew join.
    """
    told = plan(written(sized(df, id_col, text_col, source_col, spec.seed), "mix-sizes"), spec)
    columns = [c for c in df.columns if c not in ("copy", "partial")]
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("input"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    def measured(some: DataFrame) -> DataFrame:
        sized = some.withColumn("size", word_count(F.col("text"))).drop("text").filter("size > 0")
        return sized.withColumn("h", md5_hash(spec.seed, F.col("doc_id"), F.col("size"))).withColumn("place", place())

    ends = few(told.filter("cut is not null").select(F.col("source").alias("_s"), F.col("cut.doc_id").alias("_i")))
    near = docs.join(ends, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
    docs = with_part(measured(docs), measured(near), told, "mix-cut-rows")
    copies = (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    docs = docs.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    partial = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    text = F.col("input").getField(text_col)
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    return docs.select(*(F.when(partial, words).otherwise(text).alias(c) if c == text_col else F.col("input").getField(c).alias(c) for c in columns), "copy", partial.alias("partial"))
