"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits and
any non-ASCII characters.  A window is ``n`` consecutive words of an item; an
item with fewer words, but some, is one window.  Words of the benchmark get
numbers; a document's words that the benchmark does not know break its windows.
Rolling hashes of the remaining stretches are looked up in the sorted hashes of
the windows, every hit is verified word by word, and the words inside verified
hits are marked.

The broadcast: the benchmark's size is measured first.  It is scanned in blocks
of at most ``block_bytes`` of text, so what is broadcast at once never exceeds a
block (an item longer than that is a block of its own): at the default of 4 MB
some hundred MB in a worker, however large the benchmark.  A block's set is made,
broadcast, applied, its result written and the set destroyed before the next one;
a benchmark of one block is applied without a write.  :func:`report` then keeps
only the rows that a block hits, and unites their marks per document.

Edge cases: null and wordless texts have no words and are never hit; null or
wordless items have no windows; items of equal id (as text) count as one, whose
windows are those of all; items without an id hit words, but are neither counted
nor named; repeated documents are each reported; an empty benchmark leaves every
document clean; an empty table gives no rows.  :func:`decontaminate` keeps all columns of its input;
its own work columns start with an underscore and are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import parts, release, written

#: Fixed value: what is no word character, over lower-cased text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` ids (uint64, wrapping)."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _ODD + ids[k : len(ids) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


@dataclass
class WindowSet:
    """A block of the benchmark: its vocabulary, and for each window length the sorted hashes."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    #: length -> (sorted hashes, window number of each)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: window number -> its word ids, and the items that hold it
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    @staticmethod
    def build(rows: list[tuple], n: int) -> WindowSet:
        out, number = WindowSet(), {}
        for item, text in rows:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for key in dict.fromkeys(tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)) if size else ():
                if key not in number:
                    number[key] = len(out.windows)
                    out.windows.append(key)
                    out.items.append([])
                if item is not None:
                    out.items[number[key]].append(str(item))
        by_length: dict[int, list[int]] = {}
        for w, key in enumerate(out.windows):
            by_length.setdefault(len(key), []).append(w)
        for size, members in by_length.items():
            hashes = np.array([rolling(np.array(out.windows[w], np.uint64), size)[0] for w in members], np.uint64)
            order = np.argsort(hashes, kind="stable")
            out.tables[size] = hashes[order], np.array(members)[order]
        return out

    def scan(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """Marks of hit words, and the items whose windows occur."""
        hit, found = np.zeros(len(words) + 1, np.int32), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        gaps = np.flatnonzero(ids == 0)
        edges = np.concatenate(([-1], gaps, [len(ids)]))
        shortest = min(self.tables, default=0)
        for g in np.flatnonzero(np.diff(edges) > shortest) if shortest else ():
            start, stop = edges[g] + 1, edges[g + 1]
            for size, (hashes, members) in self.tables.items():
                if stop - start < size:
                    continue
                seen = rolling(ids[start:stop], size)
                at = np.searchsorted(hashes, seen)
                maybe = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == seen)
                for p in maybe:
                    k, own = at[p], tuple(ids[start + p : start + p + size].tolist())
                    while k < len(hashes) and hashes[k] == seen[p]:
                        if self.windows[members[k]] == own:
                            hit[start + p] += 1
                            hit[start + p + size] -= 1
                            found.update(self.items[members[k]])
                        k += 1
        return np.cumsum(hit[:-1]) > 0, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most ``block_bytes`` bytes of text, one on the driver at a time."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("size"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return
    if total <= block_bytes:
        yield [(r.item, r.text) for r in rows.collect()]
        return
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + r.size > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.item, r.text))
        size += r.size
    yield held


REPORT = "doc_id long, n_words long, n_hit long, items array<string>"


def _reporter(sets, pick):
    """An Arrow function that scans texts with ``sets.value``; ``pick`` makes the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sets.value
        for part in parts(batches, 256):
            scanned = []
            for text in part.column(part.num_columns - 1):
                words = words_of(text.as_py())
                scanned.append((words, *windows.scan(words)))
            yield pick(part, scanned)

    return run


def report(df: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: n_words, n_hit (words inside hits) and the items that occur in it (sorted as strings)."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pick(part, scanned):
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(w) for w, _, _ in scanned], pa.int64()), pa.array([int(h.sum()) for _, h, _ in scanned], pa.int64()), pa.array([sorted(f) for _, _, f in scanned], pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "items"],
        )

    told = blocks(benchmark, item_id_col, item_text_col, block_bytes)
    first, more = next(told, []), next(told, None)
    if more is None:
        return docs.mapInArrow(_reporter(spark.sparkContext.broadcast(WindowSet.build(first, n)), pick), REPORT)

    # Many blocks: marks of each block by row, of rows that it hits, united by the row's key.
    def marks(part, scanned):
        batch = pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([np.flatnonzero(h).tolist() for _, h, _ in scanned], pa.list_(pa.int64())), pa.array([sorted(f) for _, _, f in scanned], pa.list_(pa.string()))],
            names=["row", "hits", "items"],
        )
        return batch.filter(pa.array([bool(h.any()) for _, h, _ in scanned], pa.bool_()))

    keyed = written(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "decontaminate-docs")
    out = keyed.mapInArrow(_counter, "row long, doc_id long, n_words long")
    hit = None
    while first:
        sets = spark.sparkContext.broadcast(WindowSet.build(first, n))
        one = written(keyed.select("row", "text").mapInArrow(_reporter(sets, marks), "row long, hits array<long>, items array<string>"), "decontaminate-marks")
        sets.destroy()
        hit = one if hit is None else hit.unionByName(one)
        first, more = more or [], next(told, None)
    hit = hit.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    return out.join(hit, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 256):
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(words_of(t.as_py())) for t in part.column(2)], pa.int64())], names=["row", "doc_id", "n_words"])


def decontaminate(df: DataFrame, benchmark: DataFrame, *, n: int = 10, remove: str = "documents", share: float = 0.0, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``df`` without contamination: ``documents`` with more than ``share`` of their words hit go, or ``spans`` of hit words are cut out.

    A span runs from its first hit word to its last; what stays of the text is
    kept as it was.  Blocks of the benchmark are applied one after the other, so
    ``share`` counts a block's hits against the words that the blocks before left.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    spark, last = df.sparkSession, None
    told = blocks(benchmark, item_id_col, item_text_col, block_bytes)
    rows = next(told, None)
    while rows is not None:
        sets, rows = spark.sparkContext.broadcast(WindowSet.build(rows, n)), next(told, None)
        df = df.mapInArrow(_remover(sets, text_col, remove, share), df.schema)
        if rows is not None:  # else the caller's action applies the last set
            df = written(df, "decontaminate-clean")
            sets.destroy()
            if last is not None:
                release(last)
            last = df
    return df


def _remover(sets, text_col: str, remove: str, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sets.value
        for part in parts(batches, 256):
            at, keep, texts = part.schema.get_field_index(text_col), [], []
            for value in part.column(at):
                text = value.as_py()
                lower = text.translate(_LOWER) if text else ""
                spans = [m.span() for m in WORD.finditer(lower)]
                hit, _ = windows.scan([lower[a:b] for a, b in spans])
                if remove == "documents":
                    keep.append(not hit.any() or hit.sum() <= share * len(hit))
                else:
                    keep.append(True)
                    if hit.any():
                        text = _without(text, spans, hit)
                texts.append(text)
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    return run


def _without(text: str, spans: list[tuple[int, int]], hit: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    parts, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        parts.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*parts, text[at:]])


def digest(report: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated from :func:`report`."""
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
