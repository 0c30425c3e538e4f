"""Sentence-aware chunks with overlap, short-chunk merging and heading prefixes.

A window of ``size`` characters is cut after its last full-width sentence mark,
else after its last blank line, else after its last newline, else at its end.
Offsets are code points.  The next window starts ``overlap`` before the cut (at
the cut, if that would not advance).  A chunk that is itself shorter than
``least`` is appended to the one before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.functions.text import trim
from shiori.schema import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK

MARKS = "。！？"
#: Texts that are Python objects at once.
PART = 256


def cut_length(window: str) -> int:
    """How much of a full window goes into the chunk."""
    mark = max(map(window.rfind, MARKS))
    if mark >= 0:
        return mark + 1
    for newline in ("\n\n", "\n"):
        at = window.rfind(newline)
        if at >= 0:
            return at + len(newline)
    return len(window)


def raw_chunks(text: str, size: int, overlap: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        end = at + cut_length(text[at : at + size])
        yield trim(text[at:end])
        at = end - overlap if at < end - overlap else end
    yield trim(text[at:])


def merge_short(chunks: Iterable[str], least: int) -> list[str]:
    out: list[str] = []
    for chunk in chunks:
        if out and len(chunk) < least:
            out[-1] += "\n\n" + chunk
        else:
            out.append(chunk)
    return out


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> list[str]:
    text = trim(text)
    if len(text) <= size:
        return [text] if text else []
    return merge_short(filter(None, raw_chunks(text, size, overlap)), least)


def chunk_sections(sections: Iterable[tuple[str, str]], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> list[str]:
    """Chunks of each section's body, led by its heading; sections without a body vanish."""
    return [f"{heading}\n{chunk}" if heading else chunk for heading, body in sections for chunk in chunk_text(body, size, overlap, least)]


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> Column:
    """``array<string>`` of a text's chunks (null: none)."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return by_parts(texts, lambda part: pa.array([chunk_text(t, size, overlap, least) if t else [] for t in part], pa.list_(pa.string())))

    return split(text)


def by_parts(texts: pa.Array, made: Callable[[list[str | None]], pa.Array], rows: int = PART) -> pa.Array:
    """``made`` of a batch's texts, a few of them as Python objects at a time."""
    return pa.concat_arrays([made(texts.slice(at, rows).to_pylist()) for at in range(0, max(1, len(texts)), rows)])


def explode_chunks(df: DataFrame, chunks: Column, keys: list[str]) -> DataFrame:
    """A row per chunk: keys, chunk_id (dense from 0) and chunk_text."""
    return df.select(*keys, F.posexplode(chunks).alias("chunk_id", "chunk_text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def merge_short_rows(df: DataFrame, keys: list[str], order: str, text: str, least: int = MIN_CHUNK) -> DataFrame:
    """:func:`merge_short` over rows: each run of short rows joins the row before it (chunk_id, chunk_text)."""
    run = Window.partitionBy(*keys).orderBy(order)
    starts = F.when((F.row_number().over(run) == 1) | (F.length(text) >= least), 1).otherwise(0)
    numbered = df.withColumn("_starts", starts).withColumn("chunk_id", (F.sum("_starts").over(run) - 1).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(*keys, "chunk_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("chunk_text"))


def pack_lines(lines: Iterable[str], size: int = CHUNK_SIZE) -> list[str]:
    """Lines packed greedily into chunks of at most ``size``; a longer line stands alone."""
    out: list[str] = []
    for line in lines:
        if out and len(out[-1]) + 1 + len(line) <= size:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out
