"""Language identification by interpolated Kneser-Ney character models.

A model of order 4 per language, learned from a bounded, seeded sample of
labelled documents (whole texts).  All languages share sorted arrays of n-gram
codes (a 48-bit hash of four symbols of 12 bits); beside each code stands a row
with the interpolated log-probability in every language, and beside each context
the row of its back-off weights, so a character costs one binary search in most
cases.  A document goes to the language of lowest cross-entropy per symbol, over
the whole text; the score is that language's posterior under equal priors.

Rejection is calibrated on sampled documents that were not counted, and on their
beginnings of 1, 2, 4, ... characters.  It does not look at the cross-entropy but
at the passage loss: that of the best language of each passage of PASSAGE symbols,
per symbol, so that a passage in another known language does no harm.  A text is rejected if it has no letter, or if its loss is
above ``slack`` times its language's median loss times a ratio that hangs on its
length class (powers of two) alone: the QUANTILE of loss over the language's median,
over the class's calibration texts of all languages.  A class of fewer than
CLASS_TEXTS has the ratio of the next shorter one, so that no single document sets
it (fewer than that in every class: all in one); no class has a higher ratio than a
shorter one.  A language without calibration documents rejects only letterless texts.

Edge cases: null, empty and letterless texts get ``und`` and score 0; a null id
counts as held out and is never learned from; null languages are never learned;
without any labelled row every text is ``und``; ties go to the first language in
code-point order; repeated sample rows (same id and language) count once.  The
sample is of the least hashes of the ids, found without a task that holds a
language.  Only the named input columns are read by :func:`identify`; :func:`keep_identified`
keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import least_hashes, parts, pieces, scratch, unit_hash, written

ORDER = 4
BITS = 12
SPACE = 32
SYMBOLS = 1 << BITS
UND = "und"
#: Symbols of a passage; a divisor of the pieces that texts are measured in.
PASSAGE = 32
#: Of the calibration texts of a length class, and the fewest that make a class.
QUANTILE, CLASS_TEXTS = 0.95, 40
#: Length classes, by the bits of a text's count of symbols.
CLASSES = 64


@dataclass(frozen=True)
class LangSpec:
    #: Bound of the sample: documents per language, of which every fourth calibrates.
    docs_per_language: int = 400
    #: Folds held out: crc32 of the id as text modulo ``folds`` equal to ``held``.
    folds: int = 5
    held: int = 0
    #: Rejection: times the loss that calibration documents of that length reach.
    slack: float = 1.5
    seed: int = 41


_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Code point to symbol: letters below 0x800 are their code point, others are hashed to 11 bits, the rest is a space."""
    global _table
    if _table is None:
        letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(bool)
        points = np.arange(0x110000, dtype=np.uint64)
        hashed = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(0x7FF) | np.uint64(0x800)
        table = np.where(points < 0x800, points, hashed)
        _table = np.where(letters, table, SPACE).astype(np.uint16)
    return _table


def symbols(text: str) -> np.ndarray:
    """Symbols of a text: lower-cased letters, runs of anything else as one space; led by spaces, closed by one."""
    table = symbol_table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.empty(len(points) + ORDER, np.uint16)
    out[: ORDER - 1] = SPACE
    out[-1] = SPACE
    out[ORDER - 1 : -1] = table[points]
    space = out == SPACE
    keep = np.ones(len(out), bool)
    keep[ORDER - 1 :] = ~(space[ORDER - 1 :] & space[ORDER - 2 : -1])
    return out[keep]


def codes(run: np.ndarray) -> np.ndarray:
    """The n-gram code that ends at each symbol from the ORDER-th on."""
    n = len(run) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER) if n > 0 else ():
        out = out << np.uint64(BITS) | run[k : k + n]
    return out


def low(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of codes."""
    return code & np.uint64((1 << (BITS * n)) - 1)


@dataclass
class Model:
    languages: list[str]
    #: By order from 1: sorted n-gram codes, and log-probabilities (grams x languages).
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    #: By order from 1: sorted context codes, and log back-off weights.
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    #: Most nats a symbol (languages x length classes) of a text that is not rejected; None: nothing to calibrate on.
    limits: np.ndarray | None = None

    def symbol_logp(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of each code's last symbol after the others (codes x languages)."""
        return self._logp(code, ORDER)

    def _logp(self, code: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(code), len(self.languages)), -np.log(SYMBOLS), np.float32)
        grams = self.grams[n - 1]
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        out = self.logp[n - 1][at]
        missed = np.flatnonzero(grams[at] != code)
        if len(missed):
            rest = code[missed]
            lower = self._logp(low(rest, n - 1), n - 1)
            context, known = rest >> np.uint64(BITS), self.contexts[n - 1]
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            out[missed] = lower + np.where((known[at] == context)[:, None], self.backoff[n - 1][at], 0)
        return out


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """From each language's distinct codes and their counts to the shared sorted arrays."""
    languages = sorted(counts)
    levels = {}
    for name in languages:
        code, count = counts[name]
        own = []
        for n in range(ORDER, 0, -1):
            order = np.argsort(code)
            own.append((code[order], count[order].astype(np.float64)))
            # Continuation counts: in how many distinct contexts each shorter n-gram ends one of these.
            code, count = np.unique(low(code, n - 1), return_counts=True)
        levels[name] = own[::-1]
    grams, logp, contexts, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][n - 1][0] for x in languages]))
        known = np.unique(union >> np.uint64(BITS))
        p, b = np.empty((len(union), len(languages))), np.zeros((len(known), len(languages)))
        for j, name in enumerate(languages):
            code, count = levels[name][n - 1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            context, start = np.unique(code >> np.uint64(BITS), return_index=True)
            total = np.add.reduceat(count, start)
            kinds = np.diff(np.append(start, len(code)))
            where = np.searchsorted(known, context)
            b[where, j] = np.log(d * kinds / total)
            own = np.zeros(len(union))
            own[np.searchsorted(union, code)] = (count - d) / np.repeat(total, kinds)
            if n == 1:
                lower = np.full(len(union), 1 / SYMBOLS)
            else:
                lower = np.exp(logp[-1][np.searchsorted(grams[-1], low(union, n - 1)), j].astype(np.float64))
            p[:, j] = np.log(own + np.exp(b[np.searchsorted(known, union >> np.uint64(BITS)), j]) * lower)
        grams.append(union)
        logp.append(p.astype(np.float32))
        contexts.append(known)
        backoff.append(b.astype(np.float32))
    return Model(languages, grams, logp, contexts, backoff)


def measure(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of each text (0: no letter); by language, the sum of log-probabilities; their sum in the best language of each passage."""
    n, total, passages = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            values = model.symbol_logp(np.concatenate([c for _, c in held]))
            starts = np.cumsum([0, *(len(c) for _, c in held[:-1])])
            within = [np.arange(a, a + len(c), PASSAGE) for a, (_, c) in zip(starts, held, strict=True)]
            sums = np.add.reduceat(values, np.concatenate(within), dtype=np.float64)
            first = np.cumsum([0, *(len(w) for w in within[:-1])])
            whole, own = np.add.reduceat(sums, first), np.add.reduceat(sums.max(axis=1), first)
            for k, (i, c) in enumerate(held):
                n[i] += len(c)
                total[i] += whole[k]
                passages[i] += own[k]
            held.clear()

    for i, text in enumerate(texts):
        run = symbols(text) if text else None
        if run is None or not (run != SPACE).any():
            continue
        code = codes(run)
        for at in range(0, len(code), 1 << 18):
            part = code[at : at + (1 << 18)]
            held.append((i, part))
            size += len(part)
            if size >= 1 << 18:
                flush()
                size = 0
    flush()
    return n, total, passages


def beginnings(text: str) -> list[str]:
    """The text, and its first 1, 2, 4, ... characters."""
    return [*(text[: 1 << k] for k in range((len(text) - 1).bit_length())), text]


def length_class(n: np.ndarray) -> np.ndarray:
    """Bits of a count of symbols."""
    return np.frexp(n)[1]


def ratios(n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """By length class, the QUANTILE of the calibration texts' losses over their languages' medians."""
    out, last = np.empty(CLASSES), np.inf
    kind = length_class(n)
    known = [c for c in range(CLASSES) if (kind == c).sum() >= CLASS_TEXTS]
    first = np.quantile(ratio[kind == known[0]] if known else ratio, QUANTILE)
    for c in range(CLASSES):
        last = min(last, np.quantile(ratio[kind == c], QUANTILE) if c in known else first)
        out[c] = last
    return out


def crc_fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def sample(df: DataFrame, spec: LangSpec, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most ``docs_per_language`` documents of each language: doc, lang, text, calibrates."""
    rows = df.select(F.col(id_col).alias("doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc"), spec.folds) != spec.held))
    rows = rows.withColumn("h", unit_hash(spec.seed, F.col("doc")))
    bound = least_hashes(rows.select("lang", "h"), ["lang"], spec.docs_per_language)
    chosen = rows.join(bound, "lang").filter(F.col("h") <= F.col("top"))
    chosen = chosen.groupBy("lang", "doc").agg(F.min("text").alias("text"), F.min("h").alias("h"))
    return written(chosen.select("doc", "lang", "text", (F.col("h") % 4 == 0).alias("calibrates")), "langid-sample")


def fit(df: DataFrame, spec: LangSpec = LangSpec(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model, or None without a labelled row.  The driver gets the model's tables alone, bounded by the sample."""
    with scratch():
        return _fit(sample(df, spec, id_col, text_col, lang_col), spec)


def _fit(rows: DataFrame, spec: LangSpec) -> Model | None:
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts, strict=True) if x == name]
                for a, b in pieces(own):
                    code, n = np.unique(np.concatenate([codes(symbols(t)) for t in own[a:b]]), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(code), pa.string()), "code": pa.array(code.astype(np.int64)), "n": pa.array(n, pa.int64())})

    counted = rows.filter(~F.col("calibrates")).select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    table = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    model = train({k: (g["code"].to_numpy().astype(np.uint64), g["n"].to_numpy()) for k, g in table.groupby("lang")})

    shared = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            rows = [(x, t, t is text) for x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in beginnings(text)]
            n, _, passages = measure(shared.value, [t for _, t, _ in rows])
            loss = -passages / np.maximum(n, 1)
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(n), pa.array(loss)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "whole", "n", "loss"]).filter(pa.array(n > 0))

    seen = rows.filter(F.col("calibrates") & F.col("lang").isin(model.languages)).select("lang", "text").mapInArrow(calibrate, "lang string, whole boolean, n long, loss double").toPandas()
    if len(seen):  # else nothing to calibrate on: nothing but letterless texts is rejected
        middle = seen[seen["whole"]].groupby("lang")["loss"].median().clip(lower=1e-6)
        of_class = ratios(seen["n"].to_numpy(), (seen["loss"] / seen["lang"].map(middle)).to_numpy())
        model.limits = spec.slack * middle.reindex(model.languages, fill_value=np.inf).to_numpy()[:, None] * of_class
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double"


def decide(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
    """lang_pred, score, rejected, cross-entropy (bits a symbol) of each text."""
    if model is None:
        return [(UND, 0.0, True, None)] * len(texts)
    n, total, passages = measure(model, texts)
    best, rows, size = np.argmax(total, axis=1), np.arange(len(texts)), np.maximum(n, 1)
    ce = -total / size[:, None]
    score = 1 / np.exp(total - total[rows, best][:, None]).sum(axis=1)
    far = np.zeros(len(texts), bool) if model.limits is None else -passages / size > model.limits[best, length_class(size)]
    return [(model.languages[best[i]], float(score[i]), bool(far[i]), float(ce[i, best[i]] / np.log(2))) if n[i] else (UND, 0.0, True, None) for i in rows]


def identify(df: DataFrame, model: Model | None, spec: LangSpec = LangSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected and cross_entropy of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = decide(shared.value, batch.column(2).to_pylist())
            columns = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])

    held = crc_fold(F.col(id_col), spec.folds) == spec.held
    return df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(df: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not rejected, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([not r for _, _, r, _ in decide(shared.value, batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)
