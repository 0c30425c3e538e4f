"""Quality scores learned from preference pairs (Bradley-Terry).

Each document has a worth; of a good and a bad document the good one is
preferred with probability 1 / (1 + exp(worth_bad - worth_good)).  The worth is
linear in standardised features of the text, fitted by logistic loss on feature
differences of seeded pairs, by Newton steps.  The threshold is a quantile of the
training scores: the one that errs least on the labelled sample; scores are
shifted so that it lies at 0.7.

The sample of labelled rows is bounded (``labelled_rows``, by a seeded hash of
id and label) and read whole; scoring reads every whole text once, without a shuffle.

Edge cases: null and empty texts have the features of no words and get a score
as others do; null ids are not held out, never match a label and are scored;
repeated labels of a document count once each; without both labels in the sample
every score is 0.7 times the share of good rows (bad rows alone: 0, nothing is
predicted good; good rows alone or no label at all: 0.7, and every text is
predicted good, as nothing speaks against it).  Only the named columns are
read by :func:`score`; :func:`keep_good` keeps all columns of its input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import least_hashes, parts, scratch, unit_hash, written


@dataclass(frozen=True)
class QualitySpec:
    #: Bound of the sample of labelled rows.
    labelled_rows: int = 8000
    #: Preference pairs drawn from the sample.
    pairs: int = 60000
    folds: int = 4
    held: int = 2
    #: predicted is 1 from here on.
    threshold: float = 0.7
    seed: int = 53


FEATURES = (
    "log_words", "log_chars", "mean_word", "word_spread", "letters", "upper", "digits", "spaces", "symbols", "commas", "stops", "other_marks",
    "distinct_words", "top_word", "repeat_next", "distinct_pairs", "distinct_lines", "line_chars", "repeated_line_chars", "short_lines", "stop_lines",
    "capital_words", "upper_words", "symbol_words", "bare_marks", "long_words", "top_char", "char_entropy", "word_entropy", "packed", "pipes",
)

_LETTER = 1
_UPPER = 2
_DIGIT = 4
_SPACE = 8
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Bits of each code point up to FFFF (later ones count as letters)."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([_LETTER * c.isalpha() | _UPPER * c.isupper() | _DIGIT * c.isdigit() | _SPACE * c.isspace() for c in map(chr, range(0x10000))], np.uint8)
    return _kinds


def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def features(text: str | None) -> list[float]:
    """The features of a whole text; a text without words has zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(points)
    low = np.minimum(points, 0xFFFF)
    chars = np.bincount(low)
    used = np.flatnonzero(chars)
    weights, bits = chars[used], kinds()[used]
    visible = weights[(bits & _SPACE) == 0].sum()

    def share(bit: int) -> float:
        return float(weights[(bits & bit) > 0].sum() / n)

    def of(marks: str) -> float:
        return float(sum(chars[ord(m)] for m in marks if ord(m) < len(chars)) / n)

    k = len(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    tally = np.fromiter(counts.values(), np.int64, len(counts))
    ids = np.fromiter(map(dict(zip(counts, range(len(counts)), strict=True)).__getitem__, words), np.int64, k)
    pairs = len(np.unique(ids[:-1] * len(counts) + ids[1:])) / (k - 1) if k > 1 else 1.0
    repeats = float((ids[1:] == ids[:-1]).mean()) if k > 1 else 0.0
    lines = text.splitlines() or [text]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    again = sum(len(x) * (c - 1) for x, c in seen.items())
    capital = upper = symbol = bare = 0
    for w, c in counts.items():
        capital += c * w[:1].isupper()
        upper += c * (len(w) > 1 and w.isupper())
        last = w[-1]
        symbol += c * (not last.isalnum() and last not in ".,")
        bare += c * (not any(map(str.isalnum, w)))
    raw = text.encode("utf-8", "replace")
    # Compressibility of the whole text, window by window.
    packer = zlib.compressobj(1)
    packed = len(packer.compress(raw)) + len(packer.flush())
    return [
        np.log(k), np.log(n), float(lengths.mean()), float(lengths.std()), share(_LETTER), share(_UPPER), share(_DIGIT), share(_SPACE),
        float(weights[bits == 0].sum() / n), of(","), of("."), of("!?;:"),
        len(counts) / k**0.8, float(tally.max() / k), repeats, pairs, len(seen) / len(lines), float(np.log1p(line_sizes.mean())), again / n,
        float((line_sizes < 20).mean()), sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / len(lines) if lines else 0.0,
        capital / k, upper / k, symbol / k, bare / k, float((lengths > 25).mean()), float(weights.max() / max(1, visible)), _entropy(weights), _entropy(tally) / max(1.0, np.log(k)), min(3.0, packed / len(raw)), of("|"),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


@dataclass
class Ranker:
    #: Bounds between which features are kept, then the mean and deviation that standardise them.
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    weights: np.ndarray
    #: Worth of the threshold, and the worth's scale.
    cut: float
    scale: float
    threshold: float
    flat: float | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (np.clip(x, self.low, self.high) - self.mean) / self.dev
        return np.concatenate((z, z * z), axis=1)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in worth, ``threshold`` at the cut."""
        if self.flat is not None:
            return np.full(len(x), self.flat)
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip((self.worth(x) - self.cut) / self.scale + at, -40, 40)))


def train(x: np.ndarray, good: np.ndarray, spec: QualitySpec) -> Ranker:
    """Bradley-Terry weights from seeded pairs of a good and a bad row."""
    f = len(FEATURES)
    if good.all() or not good.any():
        return Ranker(*[np.zeros(f)] * 3, np.ones(f), np.zeros(2 * f), 0.0, 1.0, spec.threshold, flat=spec.threshold * float(good.mean() if len(good) else 1.0))
    low, high = np.quantile(x, 0.001, axis=0), np.quantile(x, 0.999, axis=0)
    kept = np.clip(x, low, high)
    ranker = Ranker(low, high, kept.mean(axis=0), np.maximum(kept.std(axis=0), 1e-6), np.zeros(2 * f), 0.0, 1.0, spec.threshold)
    z = ranker.inputs(x)
    rng = np.random.default_rng(spec.seed)
    win, lose = np.flatnonzero(good), np.flatnonzero(~good)
    diff = z[rng.choice(win, spec.pairs)] - z[rng.choice(lose, spec.pairs)]
    w = np.zeros(2 * f)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = diff.T @ p / len(diff) - 1e-3 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(2 * f)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    ranker.weights = w
    worth = z @ w
    # The quantile that errs least: below it rows are called bad.
    order = np.argsort(worth, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(np.where(good[order], 1, -1)))) + (~good).sum()
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    edge = np.concatenate(([worth[order[0]] - 1], worth[order], [worth[order[-1]] + 1]))
    ranker.cut = float((edge[at] + edge[at + 1]) / 2)
    ranker.scale = float(max(np.median(np.abs(worth - ranker.cut)) / 2, 1e-9))
    return ranker


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def fit(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Learns from at most ``labelled_rows`` labels outside the held-out fold."""
    rows = labels.select(F.col(id_col).alias("doc"), F.col(label_col).alias("label"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc"), spec.folds) != spec.held))
    rows = rows.select("doc", "label", unit_hash(spec.seed, F.col("doc"), F.col("label")).alias("h"), F.lit(0).alias("all"))
    with scratch():
        chosen = rows.join(least_hashes(rows, ["all"], spec.labelled_rows), "all").filter(F.col("h") <= F.col("top"))
        chosen = written(chosen.select("doc", "label").distinct(), "quality-labels")
        texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        # At most labelled_rows rows of two numbers: the bound of the broadcast.
        joined = texts.join(F.broadcast(chosen), "doc").select("doc", "label", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                x = matrix(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc", "label", "x"])

        # One row for each label, however often a document is repeated.
        got = joined.mapInArrow(run, "doc long, label long, x array<double>").groupBy("doc", "label").agg(F.min("x").alias("x")).toPandas().sort_values(["doc", "label"])
    if got.empty:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0, bool), spec)
    return train(np.stack(got["x"].to_numpy()), got["label"].to_numpy() == 1, spec)


def score(df: DataFrame, ranker: Ranker, spec: QualitySpec = QualitySpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            s = shared.value.scores(matrix(part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= spec.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = fold(F.col(id_col), spec.folds) == spec.held
    return df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, ranker: Ranker, *, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score at least ``least`` (by default the threshold), as they are."""
    shared, least = df.sparkSession.sparkContext.broadcast(ranker), ranker.threshold if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array(shared.value.scores(matrix(batch.column(at).to_pylist())) >= least))

    return df.mapInArrow(run, df.schema)
