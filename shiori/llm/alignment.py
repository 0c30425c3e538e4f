"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often they do.

Each text is cut into tokens by a byte-level BPE (A) and a piece BPE with byte
fallback (B), both over a space and the text.  Where tokens of both end at the same
byte, a group ends; tokens are linked if they share a group.

The work is done by DuckDB, in one in-memory database a Spark task, over parts of an
Arrow partition of about PART_TOKENS tokens: the tokens are two tables of byte
intervals, an ASOF join finds the B token over the last byte of each A token, window
sums of the shared ends number the groups, a range join brings the B tokens into the
groups' intervals, and the id pairs of a group are multiplied out by distinct ids.  A
task merges its documents' pairs into partial counts, and Spark merges those.

Counts of pairs are then brought back to the documents: the MOST_PAIRS most frequent
pairs are broadcast as sorted arrays (a bound that does not grow with the corpus), and
take nearly all occurrences, hot pairs among them; the rest of each document's pairs
meets the counts in a shuffle join.

Edge cases: a null or empty text, or one whose tokens' bytes differ from space and
text (say, it holds U+2581, which B takes for a space), has no tokens: zeros and an
empty digest.  Special tokens' strings are plain text.  Repeated rows are documents
of their own; a null id is kept; only the named columns are read.  A text is held
whole by its task, with some hundred bytes a token.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm.common import parts, pieces, scratch, written

#: Characters of the texts that are joined at once, about (some 400,000 tokens), and what DuckDB may hold.
PART_CHARS, MEMORY = 1 << 19, "500MB"
#: Pairs that a task counts before it hands its counts on.
PARTIAL_PAIRS = 500_000
#: Pairs that are broadcast with their counts (17 MB).
MOST_PAIRS = 1 << 20
#: B ids lie below this, A ids below 2^16, so a pair is one int.
B_IDS = 1 << 15


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the tokenizers' files (a few MB each), read by Spark and broadcast."""

    byte_bpe: str = "/opt/tokenizers/byte_bpe_50k.json"
    piece_bpe: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 characters are their byte, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, loaded from their files' contents, with the bytes of every token."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        told = json.loads(byte_bpe)
        self.plain = Tokenizer.from_str(byte_bpe.decode())
        self.plain.encode_special_tokens = True
        alphabet = byte_alphabet()
        special = {t["content"] for t in told.get("added_tokens", [])}
        self.a_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) if t not in special else t.encode() for t, i in told["model"]["vocab"].items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.b_bytes = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        if max(self.a_bytes) >= 1 << 16 or max(self.b_bytes) >= B_IDS:
            raise ValueError("token ids beyond 2^16 (A) or 2^15 (B)")
        self.fast = self._ranked(told, special)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ranked(self, told: dict, special: set[str]):
        """The same BPE by ranks, some four times as fast, if the merges are in the order of their ids; else None."""
        import tiktoken
        from public_tokenizers import PATTERN

        model, pre = told["model"], told["pre_tokenizer"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][x + y] for x, y in pairs]
        usual = pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
        ranked = {b: i for i, b in self.a_bytes.items() if self.plain.id_to_token(i) not in special}
        if not usual or ids != sorted(set(ids)) or len(ids) + 256 != len(ranked):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={})

    def a_ids(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as x:  # a run of white space beyond its regular expression's stack
                if isinstance(x, (KeyboardInterrupt, SystemExit)):
                    raise
        return self.plain.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of each text, none where they do not stand for its bytes."""
        full = [t or "" for t in texts]
        out = []
        for text, b in zip(full, self.b.encode(full, num_threads=1), strict=True):
            a = self.a_ids(" " + text) if text else []
            raw = (" " + text).encode()
            same = text and b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((np.array(a if same else [], np.int32), np.array(b if same else [], np.int32)))
        return out

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each token, by id."""
        return tuple(np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.a_bytes, self.b_bytes))


@lru_cache(maxsize=1)
def _loaded(byte_bpe: bytes, piece_bpe: bytes) -> tuple[Pair, np.ndarray, np.ndarray]:
    """A worker's tokenizers."""
    pair = Pair(byte_bpe, piece_bpe)
    return pair, *pair.lengths()


#: Over tables a and b (doc, id, s, e: a token and its bytes, by position over all texts of the part).
ALIGN = f"""
-- Tokens of the same bytes: groups of one token each.
CREATE OR REPLACE TEMP TABLE same AS SELECT a.doc, a.id * {B_IDS} + b.id AS pair, a.e FROM a JOIN b ON a.s = b.s AND a.e = b.e;
CREATE OR REPLACE TEMP TABLE ra AS SELECT * FROM a ANTI JOIN same ON a.e = same.e;
CREATE OR REPLACE TEMP TABLE rb AS SELECT * FROM b ANTI JOIN same ON b.e = same.e;
-- The others: a group ends where an A token ends with the B token over its last byte.
CREATE OR REPLACE TEMP TABLE aw AS
  SELECT doc, id, s, e, coalesce(sum(cut) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g
  FROM (SELECT ra.doc, ra.id, ra.s, ra.e, (ra.e = rb.e)::INT AS cut FROM ra ASOF JOIN rb ON ra.e > rb.s);
CREATE OR REPLACE TEMP TABLE groups AS SELECT g, min(s) AS s, max(e) AS e FROM aw GROUP BY g;
CREATE OR REPLACE TEMP TABLE bw AS SELECT rb.id, groups.g FROM rb JOIN groups ON rb.s >= groups.s AND rb.e <= groups.e;
CREATE OR REPLACE TEMP TABLE pairs AS
  WITH x AS (SELECT g, doc, id, count(*) AS n FROM aw GROUP BY ALL), y AS (SELECT g, id, count(*) AS n FROM bw GROUP BY ALL),
  linked AS (SELECT doc, pair, 1 AS n FROM same UNION ALL SELECT doc, x.id * {B_IDS} + y.id, x.n * y.n FROM x JOIN y USING (g))
  SELECT doc, pair, sum(n)::BIGINT AS n FROM linked GROUP BY ALL;
"""

#: Of each document: its own columns, then its linked pairs and how often each is linked; a row of partial counts has the last two alone.
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>, pair int, docs long"
_TYPES = (*[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@lru_cache(maxsize=1)
def digits() -> tuple[np.ndarray, np.ndarray]:
    """By id, its five decimal digits and whether each is written."""
    ids = np.arange(1 << 16)
    places = ids[:, None] // 10 ** np.arange(4, -1, -1)
    return (places % 10 + ord("0")).astype(np.uint8), (places > 0) | (np.arange(5) == 4)


def digests(tokens: list[tuple[np.ndarray, np.ndarray]], last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """Of each text, the SHA-256 of ``a1,a2|b1;a3|b2``; ``last_a``, ``last_b``: whether a token of the part ends its group."""
    figures, shown = digits()
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    # A token of A stands behind the B tokens of the groups before its own, one of B behind the A tokens up to its own group.
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    at_a = np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]
    at_b = np.arange(len(b)) + ends_a[group_b]
    n = len(a) + len(b)
    ids, marks = np.empty(n, np.int32), np.empty(n, np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a], marks[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    line = np.concatenate((figures[ids], marks[:, None]), axis=1)
    keep = np.concatenate((shown[ids], np.ones((n, 1), bool)), axis=1)
    written_ends = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    told = line[keep].tobytes()
    stops = np.cumsum([len(x) + len(y) for x, y in tokens])
    starts = stops - [len(x) + len(y) for x, y in tokens]
    # Without the mark behind the last group.
    return [hashlib.sha256(told[written_ends[i] : written_ends[j] - 1]).hexdigest() if j > i else "" for i, j in zip(starts, stops, strict=True)]


class Aligner:
    """A task's database: alignments of its parts, and partial counts of their pairs."""

    def __init__(self, pair: Pair, len_a: np.ndarray, len_b: np.ndarray) -> None:
        self.pair, self.lengths = pair, (len_a, len_b)
        self.base = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        self.base.execute("CREATE TABLE partial (pair INT, docs BIGINT)")

    def _side(self, tokens: list[tuple[np.ndarray, np.ndarray]], k: int) -> pa.Table:
        ids = np.concatenate([t[k] for t in tokens])
        size = self.lengths[k][ids]
        end = np.cumsum(size)
        doc = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t[k]) for t in tokens])
        return pa.table({"doc": doc, "id": ids, "s": end - size, "e": end})

    def align(self, texts: list[str | None]) -> list:
        """Columns n_a to times of SCHEMA."""
        tokens = self.pair.tokens(texts)
        none = np.zeros(len(texts), np.int64)
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        if not n_a.any():
            lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
            return [none, none, none, none, pa.array([""] * len(texts), pa.string()), lists, lists.cast(pa.list_(pa.int64()))]
        a, b = self._side(tokens, 0), self._side(tokens, 1)
        for name, side in (("a", a), ("b", b)):
            self.base.register(name, side)
        self.base.execute(ALIGN)
        self.base.execute("INSERT INTO partial SELECT pair, count(*) FROM pairs GROUP BY pair")
        found = self.base.sql("SELECT doc, pair, n FROM pairs ORDER BY doc, pair").to_arrow_table()
        ends = self.base.sql("SELECT e FROM same UNION ALL SELECT e FROM groups").to_arrow_table().column(0).to_numpy()
        doc, times = found.column(0).to_numpy(), found.column(2).to_numpy()
        marks = np.zeros(a.column("e")[-1].as_py() + 1, bool)
        marks[ends] = True
        last_a, last_b = marks[a.column("e").to_numpy()], marks[b.column("e").to_numpy()]
        n_groups = np.bincount(a.column("doc").to_numpy()[last_a], minlength=len(texts))
        upto = np.concatenate(([0], np.cumsum(times)))
        offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (found.column(1).to_numpy().astype(np.int32), times)]
        return [n_a, n_b, n_groups, upto[offsets[1:]] - upto[offsets[:-1]], pa.array(digests(tokens, last_a, last_b), pa.string()), *lists]

    def partial(self, most: int) -> pa.RecordBatch | None:
        """The counts so far, if they have more than ``most`` rows, which are then forgotten."""
        if self.base.execute("SELECT count(*) FROM partial").fetchall()[0][0] <= most:
            return None
        merged = self.base.sql("SELECT pair, sum(docs)::BIGINT AS docs FROM partial GROUP BY pair").to_arrow_table()
        self.base.execute("DELETE FROM partial")
        if len(merged) <= most // 2:  # repeats for the most part: go on counting
            self.base.register("merged", merged)
            self.base.execute("INSERT INTO partial SELECT * FROM merged")
            return None
        n = len(merged)
        columns = [pa.nulls(n, t) for t in _TYPES[:-2]] + [merged.column(k).combine_chunks().cast(t) for k, t in enumerate(_TYPES[-2:])]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def linked(df: DataFrame, tokenizers: Tokenizers = Tokenizers(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA and ``row`` (a number of its own for each row): the documents' alignments, and the tasks' partial counts; a written table."""
    spark = df.sparkSession
    files = spark.sparkContext.broadcast(tuple(_content(spark, p) for p in (tokenizers.byte_bpe, tokenizers.piece_bpe)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in parts(batches):
            own = own or Aligner(*_loaded(*files.value))
            texts = batch.column(1).to_pylist()
            for i, j in pieces(texts, PART_CHARS):
                columns = [batch.column(0).slice(i, j - i), *own.align(texts[i:j]), *(pa.nulls(j - i, t) for t in _TYPES[-2:])]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_NAMES)
            if (full := own.partial(PARTIAL_PAIRS)) is not None:
                yield full
        if own and (rest := own.partial(0)) is not None:
            yield rest

    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "align-linked")


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked, and whether no other pair of its A id is in more; a written table."""
    counts = written(found.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    a = F.shiftright("pair", 15)
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("_most"))  # 2^16 rows at most
    return written(counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best")), "align-pairs")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``counts``, ``most`` at the utmost: all from some count on."""
    class_of = F.floor(64 * F.log2("docs"))
    left, least = most, None
    for c, n in sorted(((r[0], r[1]) for r in counts.groupBy(class_of.alias("c")).agg(F.count(F.lit(1))).collect()), reverse=True):  # 64 rows for each power of two
        if n > left:
            break
        left, least = left - n, c
    return counts.filter(F.lit(False) if least is None else class_of >= least)


#: Of one document's pairs: links whose count is the highest, counts over links, and the pairs that were not looked up.
KNOWN = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:int,n:long>>"


def align(df: DataFrame, tokenizers: Tokenizers = Tokenizers(), *, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    spark = df.sparkSession
    with scratch() as keep:
        found = keep(linked(df, tokenizers, id_col=id_col, text_col=text_col))
        counts = pair_counts(found)
        top = frequent(counts, most_pairs)
        local = top.select("pair", "docs", "best").toPandas().sort_values("pair")
        table = spark.sparkContext.broadcast((local["pair"].to_numpy(np.int32), local["docs"].to_numpy(np.int64), local["best"].to_numpy(bool)))
        whole = len(local) == counts.count()
        known = with_known(found, table)
        if whole:
            return known.select(*RESULT)
        known = keep(written(known, "align-known"))
        rest = known.select("row", F.explode("rest").alias("r")).select("row", F.col("r.pair").alias("pair"), F.col("r.n").alias("n"))
        rest = rest.join(counts.join(top.select("pair"), "pair", "left_anti"), "pair")
        more = keep(written(rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("docs")).alias("_sum")), "align-rest"))
    out = known.join(more, "row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(*RESULT)


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_known(found: DataFrame, table) -> DataFrame:
    """KNOWN of the documents of ``found``; ``table``: sorted pairs, their counts, and whether they are best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = table.value
        for batch in parts(batches):
            lists = batch.column(7)
            own, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (7, 8))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            here, n = at[hit], times[hit]
            sums = []
            for value in (n * best[here], n * docs[here]):
                upto = np.zeros(batch.num_rows, np.int64)
                np.add.at(upto, row[hit], value)
                sums.append(pa.array(upto))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows)))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(own[~hit]), pa.array(times[~hit])], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), *sums, rest], names=[c.split()[0] for c in KNOWN.split(", ")])

    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    return found.filter("pair is null").select(*columns).mapInArrow(run, KNOWN)
