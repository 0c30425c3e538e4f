"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds calibrated by language.

A word is the sum of rows of one hashed table: for the word itself and for its first
STEM letters.  Filters of several widths run over the words, each keeps its greatest
value over the whole text (max pooling), and a logistic layer reads those.  Rows of
the table that fewer than ``least_docs`` training texts use are zero and stay so, so
that unseen words do not matter.  Training: logistic loss, dropout of words and of
pooled features, Adagrad.

The model is learned from every labelled row outside the held-out fold.  Rows are
dealt by a hash of their id to shards of about ``labelled_rows`` rows, one shard to a
task.  In each of a few rounds every shard trains on from the same net; the new net is
the mean of theirs, for a row of the table the mean over the shards that changed it.
Means are sums of whole numbers, so that partitions and their order do not matter.
What the driver holds is bounded by the size of the net.

Every fourth labelled row is not trained on but sets the thresholds: each language gets
the one that errs least over all of its such rows (counted by logits in steps of
STEP), at the rate at which toxic labels occur; languages with few such rows share the
threshold of all.  Scores are shifted so that the threshold of the text's language lies
at ``threshold``.  A text's language is told from its hashed words alone, by naive
Bayes over counts of all documents outside the fold that have a language.

Scoring reads every whole text once, without a shuffle.

Edge cases: null and empty texts, and those without a letter or digit, have one empty
window and get its score; null ids are not held out, never match a label and are
scored; repeated labels of a document count once each, repeated rows are each scored.
Without a toxic label every score is 0, with toxic labels alone every score is 1.
Only the named columns are read by :func:`score`; :func:`keep_clean` keeps all columns.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm import langid
from shiori.llm.common import few, parts, scratch, unit_hash, written

#: Letters of a word's stem, and the rows that a word is the sum of: word, stem.
STEM, ROWS = 4, 2
#: Characters of a text that are hashed at once.
SEGMENT = 1 << 20
#: Words whose vectors are held at once, and words of a shard that are held at once, but for a longer text.
CHUNK, SHARD_WORDS = 1 << 13, 1 << 21
#: Characters of a shard, about, where its texts are long.
SHARD_CHARS = 1 << 24
#: Hashed words that languages are told by.
LANGUAGE_ROWS = 1 << 16
#: Logits are counted in steps of this size, from -MOST to MOST.
STEP, MOST = 2.0**-10, 40
#: Unit of the sums that means of nets are made of.
UNIT = 2.0**-20
_R = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicSpec:
    #: Of a shard, about; all labelled rows are in one.
    labelled_rows: int = 4000
    folds: int = 4
    held: int = 2
    #: predicted is 1 from here on.
    threshold: float = 0.3
    buckets: int = 1 << 18
    dim: int = 16
    #: Ascending.
    widths: tuple[int, ...] = (1, 2, 3)
    #: Of each width.
    filters: int = 16
    least_docs: int = 3
    #: Passes over the rows, and steps in all, at least.
    epochs: int = 8
    steps: int = 1500
    #: Times that the shards' nets are brought together.
    rounds: int = 4
    batch: int = 32
    rate: float = 0.05
    word_dropout: float = 0.1
    feature_dropout: float = 0.3
    #: Texts of each label that make a language's own threshold.
    language_texts: int = 12
    seed: int = 61


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point, whether it is part of a word."""
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), np.uint8).astype(bool)
    return _letters


def _mixed(h: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    """Rows from 1 (0 is the empty row)."""
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(40)).astype(np.int64) % (buckets - 1) + 1


def words(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of lower-cased ``text``: its rows of the table (words x ROWS), and the place of its first character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = letters()[points]
    starts, ends = (np.flatnonzero(x) for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
    if not len(starts):
        return np.zeros((0, ROWS), np.int32), starts
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), _R, np.uint64))
    value = points[inside[1:-1]].astype(np.uint64) * powers[place]
    whole = np.add.reduceat(value, first)
    value[place >= STEM] = 0
    rows = [_mixed(h, salt, buckets) for salt, h in enumerate((whole, np.add.reduceat(value, first)), 1)]
    return np.stack(rows, axis=1).astype(np.int32), starts


def segments(text: str, spec: ToxicSpec) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows of the words of a text, by segments that end between words, each beginning with the last words of the one before."""
    at, gap, limit = 0, max(spec.widths) - 1, SEGMENT
    table = letters()
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and table[ord(text[cut])]:
            cut += 1
        own, starts = words(text[at:cut], spec.buckets)
        if cut == len(text):
            yield own, True
            return
        if len(own) <= 2 * gap:
            limit *= 2  # words of great length
            continue
        yield own, False
        at, limit = at + int(starts[-gap]) if gap else cut, SEGMENT
    yield words(text[at:], spec.buckets)[0], True


def rows_of(text: str | None, spec: ToxicSpec) -> np.ndarray:
    """Rows of all words of a text."""
    gap = max(spec.widths) - 1
    return np.concatenate([own if last else own[: len(own) - gap] for own, last in segments((text or "").lower(), spec)])


@dataclass
class Languages:
    names: list[str]
    #: Log-probability of each hashed word (LANGUAGE_ROWS x languages).
    logp: np.ndarray

    def of(self, total: np.ndarray) -> list[str | None]:
        """The languages of texts from their sums of log-probabilities; None: no words."""
        return [self.names[i] if any_ else None for i, any_ in zip(total.argmax(axis=1), total.any(axis=1), strict=True)]


def language_rows(ids: np.ndarray) -> np.ndarray:
    """Places among LANGUAGE_ROWS of rows of the table; the empty row's is 0."""
    return np.where(ids > 0, ids % (LANGUAGE_ROWS - 1) + 1, 0)


@dataclass
class Net:
    spec: ToxicSpec
    table: np.ndarray
    #: By width: kernels (width x dim x filters) and biases.
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    #: Score of every text, if nothing could be learned.
    flat: float | None = None
    #: Logit of the threshold by language, and for all others.
    cuts: dict[str, float] = field(default_factory=dict)
    cut: float = 0.0
    languages: Languages | None = None
    #: Labelled rows that were trained on, and that set the thresholds.
    trained: int = 0
    tested: int = 0

    @property
    def most(self) -> int:
        return max(self.spec.widths)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.table.take(ids[:, 0], axis=0)
        for r in range(1, ROWS):
            x += self.table.take(ids[:, r], axis=0)
        return x

    def windows(self, x: np.ndarray) -> np.ndarray:
        """The filters' values at each word but the last ``most - 1`` (words x filters, by width)."""
        n, filters = len(x) - self.most + 1, self.spec.filters
        z = np.tile(np.concatenate(self.biases), (n, 1))
        for k in range(self.most):
            reach = [i for i, w in enumerate(self.spec.widths) if w > k]  # widths ascend: the last ones
            z[:, reach[0] * filters :] += x[k : n + k] @ np.concatenate([self.kernels[i][k] for i in reach], axis=1)
        return z

    def read(self, runs: Iterable[tuple[int, np.ndarray, bool]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``n`` texts, given by segments of their words (owner, rows, whether the last): pooled features, and sums by language."""
        out, total = np.full((n, len(self.out)), -np.inf, np.float32), np.zeros((n, len(self.languages.names) if self.languages else 0))
        gap = self.most - 1
        rows, start, stop, owner, at = [], [], [], [], 0

        def flush() -> None:
            ids = np.concatenate(rows)
            x = self.vectors(ids)
            edges = np.stack((start, stop), axis=1).ravel()
            # One empty window more, as the last edge is the end.
            z = self.windows(np.concatenate((x, np.zeros((gap + 1, x.shape[1]), np.float32))))
            np.maximum.at(out, owner, np.maximum.reduceat(z, edges)[::2])
            if self.languages:
                told = self.languages.logp[language_rows(ids)].sum(axis=1, dtype=np.float64)
                np.add.at(total, owner, np.add.reduceat(np.concatenate((told, told[-1:])), edges)[::2])

        for k, own, last in runs:
            # Windows at the last words of a segment that goes on are those of the next one's first.
            count = max(len(own), 1) if last else len(own) - gap
            rows += [own, np.zeros((gap + (not len(own)), ROWS), np.int32)]
            start.append(at)
            stop.append(at + count)
            owner.append(k)
            at += max(len(own), 1) + gap
            if at >= CHUNK:
                flush()
                rows, start, stop, owner, at = [], [], [], [], 0
        if rows:
            flush()
        return np.maximum(out, 0), total

    def _runs(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, bool]]:
        return ((k, *run) for k, text in enumerate(texts) for run in segments((text or "").lower(), self.spec))

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """The greatest value of each filter over each text (texts x filters), 0 at least."""
        return self.read(self._runs(texts), len(texts))[0]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self._logits(self.pooled(texts))

    def _logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.out + self.bias

    def judged(self, runs: Iterable[tuple[int, np.ndarray, bool]], n: int) -> tuple[np.ndarray, list[str | None]]:
        """Logits and languages."""
        pooled, total = self.read(runs, n)
        return self._logits(pooled), self.languages.of(total) if self.languages else [None] * n

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; ``threshold`` at the cut of the text's language."""
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        z, lang = self.judged(self._runs(texts), len(texts))
        cut = np.array([self.cuts.get(x, self.cut) for x in lang])
        at = np.log(self.spec.threshold / (1 - self.spec.threshold))
        return 1 / (1 + np.exp(-np.clip(z - cut + at, -MOST, MOST)))


@dataclass
class State:
    """A net in training: with the rows of the table that are used, and Adagrad's sums."""

    net: Net
    used: np.ndarray
    squares: dict[str, np.ndarray]

    def dense(self) -> list[np.ndarray]:
        """All but the table and its sums."""
        net = self.net
        return [*net.kernels, *net.biases, net.out, *(self.squares[k] for k in sorted(self.squares) if k != "table")]

    def flat(self) -> np.ndarray:
        """All but the table, in rows as wide as one of the table and its sum."""
        found = np.concatenate([*(x.ravel() for x in self.dense()), [self.net.bias]])
        width = self.net.spec.dim + 1
        return np.pad(found, (0, -len(found) % width)).reshape(-1, width)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate((self.net.table[at], self.squares["table"][at, None]), axis=1)

    def put(self, place: np.ndarray, values: list[np.ndarray]) -> None:
        """Sets rows of the table, and those of :meth:`flat` at places from ``buckets`` on, which are all there; by columns."""
        inside = place < self.net.spec.buckets
        at, order = place[inside], np.argsort(place[~inside])
        for i, own in enumerate(values[:-1]):
            self.net.table[at, i] = own[inside]
        self.squares["table"][at] = values[-1][inside]
        rest = np.stack([own[~inside][order] for own in values], axis=1).ravel()
        for x in self.dense():
            x[...] = rest[: x.size].reshape(x.shape)
            rest = rest[x.size :]
        self.net.bias = float(rest[0])


def begin(seen: np.ndarray, spec: ToxicSpec) -> State:
    """An untrained net; ``seen``: the training texts that use each row of the table."""
    rng = np.random.default_rng(spec.seed)
    used = seen >= spec.least_docs
    used[0] = False
    table = np.zeros((spec.buckets, spec.dim), np.float32)
    table[used] = rng.normal(0, 0.1, (int(used.sum()), spec.dim))
    kernels = [rng.normal(0, (w * spec.dim) ** -0.5, (w, spec.dim, spec.filters)).astype(np.float32) for w in spec.widths]
    net = Net(spec, table, kernels, [np.zeros(spec.filters, np.float32) for _ in spec.widths], rng.normal(0, 0.3, spec.filters * len(spec.widths)).astype(np.float32))
    squares = {"table": np.full(spec.buckets, 1e-3, np.float32), "out": np.full_like(net.out, 1e-3)}
    for k in range(len(spec.widths)):
        squares |= {f"kernel{k}": np.full_like(kernels[k], 1e-3), f"bias{k}": np.full_like(net.biases[k], 1e-3)}
    return State(net, used, squares)


def passes(rows: int, spec: ToxicSpec) -> int:
    """Over ``rows`` rows, in all rounds."""
    return max(spec.epochs, min(20, -(-spec.steps * spec.batch // max(1, rows))))


def descend(state: State, rows: list[np.ndarray], toxic: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Trains on, over texts (rows of their words) and their labels."""
    net, squares, used = state.net, state.squares, state.used
    spec, table, kernels = net.spec, net.table, net.kernels
    dim, width = spec.dim, net.most

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        squares[name] += grad * grad
        value -= spec.rate * grad / np.sqrt(squares[name])

    rows = [np.where(used[own], own, 0) for own in rows]
    empty = np.zeros((width, ROWS), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), spec.batch):
            chosen = order[first : first + spec.batch]
            ids = np.concatenate([part for i in chosen for part in (rows[i], empty)])
            ids[rng.random(len(ids), np.float32) < spec.word_dropout] = 0
            start = np.cumsum([0, *(len(rows[i]) + width for i in chosen[:-1])])
            stop = start + [max(1, len(rows[i])) for i in chosen]
            peak, place = peaks(net, ids, start, stop)
            kept = (rng.random(peak.shape) >= spec.feature_dropout) / (1 - spec.feature_dropout)
            h = np.maximum(peak, 0) * kept
            error = (1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -40, 40))) - toxic[chosen]) / len(chosen)
            back = (error[:, None] * net.out * kept * (peak > 0)).astype(np.float32)
            step("out", net.out, (h.T @ error).astype(np.float32))
            net.bias -= spec.rate * float(error.sum())
            touched, grads = [], []
            for k, kernel in enumerate(kernels):
                own, p = (x[:, k * spec.filters : (k + 1) * spec.filters] for x in (back, place))
                by_place = [table[ids[p + s]].sum(axis=2) for s in range(len(kernel))]
                for s in range(len(kernel)):
                    touched.append(ids[p + s].reshape(-1, ROWS))
                    grads.append((own[:, :, None] * kernel[s].T).reshape(-1, dim))
                step(f"kernel{k}", kernel, np.stack([np.einsum("df,dfe->ef", own, v) for v in by_place]))
                step(f"bias{k}", net.biases[k], own.sum(axis=0))
            where, grad = np.concatenate(touched), np.concatenate(grads)
            live = grad.any(axis=1)
            where, grad = where[live].T.ravel(), np.tile(grad[live], (ROWS, 1))
            one, at = np.unique(where, return_inverse=True)
            total = np.zeros((len(one), dim), np.float32)
            np.add.at(total, at, grad)
            total[one == 0] = 0
            squares["table"][one] += (total * total).mean(axis=1)
            table[one] -= spec.rate * total / np.sqrt(squares["table"][one])[:, None]


def peaks(net: Net, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each filter over each text (texts x filters), and where it is, by CHUNK words at a time."""
    peak = np.full((len(start), len(net.out)), -np.inf, np.float32)
    place = np.zeros(peak.shape, np.int64)
    for low in range(0, int(stop[-1]), CHUNK):
        high = min(low + CHUNK, int(stop[-1]))
        z = net.windows(net.vectors(ids[low : high + net.most - 1]))
        for i in range(int(np.searchsorted(stop, low, "right")), int(np.searchsorted(start, high))):
            a, b = max(low, int(start[i])), min(high, int(stop[i]))
            at = z[a - low : b - low].argmax(axis=0)
            best = z[a - low + at, np.arange(z.shape[1])]
            better = best > peak[i]
            peak[i][better], place[i][better] = best[better], (a + at)[better]
    return peak, place


def train(rows: list[np.ndarray], toxic: np.ndarray, spec: ToxicSpec) -> Net:
    """The net of one shard alone: texts (rows of their words) and their labels."""
    seen = np.zeros(spec.buckets, np.int64)
    for own in rows:
        seen[np.unique(own)] += 1
    state = begin(seen, spec)
    descend(state, rows, toxic, passes(len(rows), spec), np.random.default_rng(spec.seed + 1))
    return state.net


def best_cut(z: np.ndarray, toxic: np.ndarray, rate: float, n: np.ndarray | None = None) -> float:
    """The logit that errs least where a share ``rate`` of the texts is toxic: the middle of the best gap, the highest of several; ``n`` texts have each logit."""
    n = np.ones(len(z)) if n is None else n
    order = np.argsort(z, kind="stable")
    weight = (n * np.where(toxic, rate / max(1, n[toxic].sum()), (1 - rate) / max(1, n[~toxic].sum())))[order]
    # Wrong from each gap on: toxic texts below it, clean ones above.
    wrong = np.concatenate(([0.0], np.cumsum(np.where(toxic[order], weight, -weight)))) + weight[~toxic[order]].sum()
    wrong[1:-1][z[order][1:] == z[order][:-1]] = np.inf  # no gap between equal logits
    last = np.flatnonzero(wrong <= wrong.min() + 1e-12)[-1]
    edge = np.concatenate(([z[order[0]] - 1], z[order], [z[order[-1]] + 1]))
    return float((edge[last] + edge[last + 1]) / 2)


#: A shard's rows, or a part of them: row numbers of the words of all texts one after another, and their counts.
PACKED = "tests boolean, shard long, n long, words binary, sizes binary, toxic binary"


def packed(docs: DataFrame, labels: DataFrame, spec: ToxicSpec, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """All labelled texts outside the held-out fold, as rows of their words, by shards; each (id, label) once."""
    rows = labels.select(F.col(id_col).alias("doc"), (F.col(label_col) == 1).alias("toxic"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("toxic").isNotNull() & (langid.crc_fold(F.col("doc"), spec.folds) != spec.held)).distinct()
    chosen = written(rows.withColumn("h", unit_hash(spec.seed, F.col("doc"))), "toxic-labels")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = texts.filter(F.col("doc").isNotNull() & (langid.crc_fold(F.col("doc"), spec.folds) != spec.held))
    chosen = few(chosen)
    size = texts.select("doc", F.length("text").alias("size")).join(chosen, "doc").agg(F.count_if(F.col("h") % 4 != 0).alias("rows"), F.sum("size").alias("chars")).first()
    shards = max(1, -(-size.rows // spec.labelled_rows), -(-(size.chars or 0) // SHARD_CHARS))
    joined = texts.join(chosen, "doc").select("doc", "toxic", "h", F.coalesce("text", F.lit("")).alias("text"))
    joined = joined.withColumns({"tests": F.col("h") % 4 == 0, "shard": F.shiftright("h", 8) % shards})
    dealt = joined.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "tests", "h", "doc", "toxic", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, own, labels, held = None, None, [], [], 0

        def full() -> pa.RecordBatch:
            row = [[key[0]], [key[1]], [len(own)], [np.concatenate(own).tobytes()], [np.array([len(x) for x in own], np.int64).tobytes()], [np.array(labels, bool).tobytes()]]
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["tests", "shard", "n", "words", "sizes", "toxic"])

        for batch in parts(batches, 256):
            for shard, tests, h, doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, doc, toxic) == before:
                    continue
                if own and (key != (tests, shard) or held >= SHARD_WORDS):
                    yield full()
                    own, labels, held = [], [], 0
                key, before = (tests, shard), (h, doc, toxic)
                own.append(rows_of(text, spec))
                labels.append(toxic)
                held += len(own[-1])
        if own:
            yield full()

    return written(dealt.select("shard", "tests", "h", "doc", "toxic", "text").mapInArrow(pack, PACKED), "toxic-shards")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Number, texts and labels of each packed row of (shard, words, sizes, toxic)."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, ids, sizes, toxic = (c[i].as_py() for c in batch.columns)
            ends = np.cumsum(np.frombuffer(sizes, np.int64))
            yield shard, np.split(np.frombuffer(ids, np.int32).reshape(-1, ROWS), ends[:-1]), np.frombuffer(toxic, bool)


def trained(shards: DataFrame, one: bool, rows: int, spec: ToxicSpec) -> Net:
    """The net from packed rows, all of them; ``one``: there is one only."""
    spark = shards.sparkSession
    shards = shards.select("shard", "words", "sizes", "toxic")
    names = [f"v{i}" for i in range(spec.dim + 1)]

    def using(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(spec.buckets, np.int64)
        for _, texts, _ in unpacked(batches):
            for own in texts:
                seen[np.unique(own)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["place", "n"])

    counted = shards.mapInArrow(using, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(spec.buckets, np.int64)
    seen[counted["place"].to_numpy()] = counted["n"].to_numpy()
    state = begin(seen, spec)
    rounds = 1 if one else spec.rounds
    epochs = -(-passes(rows, spec) // rounds)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, texts, toxic in unpacked(batches):
                own = copy.deepcopy(shared.value)
                descend(own, texts, toxic.astype(float), epochs, np.random.default_rng((spec.seed, turn, shard, len(texts))))
                at = np.flatnonzero(own.squares["table"] != shared.value.squares["table"])
                flat = own.flat()
                place = np.concatenate((at, spec.buckets + np.arange(len(flat))))
                values = np.round(np.concatenate((own.rows(at), flat)).astype(np.float64) / UNIT).astype(np.int64) * len(texts)
                columns = [pa.array(place), pa.array(np.full(len(place), len(texts))), *(pa.array(np.ascontiguousarray(v)) for v in values.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "n", *names])

        schema = ", ".join(f"{c} long" for c in ("place", "n", *names))
        merged = shards.mapInArrow(run, schema).groupBy("place").agg(*((F.sum(c) / F.sum("n") * UNIT).cast("float").alias(c) for c in names)).toArrow()
        state.put(merged["place"].to_numpy(), [merged[c].to_numpy() for c in names])
        del merged
        shared.destroy()
    return state.net


def tell_languages(docs: DataFrame, spec: ToxicSpec, id_col: str, text_col: str, lang_col: str) -> Languages | None:
    """From all documents outside the held-out fold that have a language; None without any."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (langid.crc_fold(F.col("doc"), spec.folds) != spec.held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "place", "n"])
            sums.clear()

        for batch in parts(batches):
            found: dict[str, list[np.ndarray]] = {}
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(name, []).append(language_rows(rows_of(text, spec).ravel()))
            for name, own in found.items():
                own = np.bincount(np.concatenate(own), minlength=LANGUAGE_ROWS)
                sums[name] = sums[name] + own if name in sums else own
                if len(sums) >= 64:
                    yield from flush()
        yield from flush()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    names = sorted(counted["lang"].unique().to_pylist())
    n = np.zeros((LANGUAGE_ROWS, len(names)))
    n[counted["place"].to_numpy(), pc.index_in(counted["lang"], pa.array(names, pa.string())).to_numpy()] = counted["n"].to_numpy()
    logp = np.log((n + 0.5) / (n + 0.5).sum(axis=0))
    logp[0] = 0  # the empty row
    return Languages(names, logp.astype(np.float32))


def calibrate(net: Net, shards: DataFrame, rate: float) -> None:
    """Sets the thresholds from packed rows that were not trained on, all of them."""
    shared = shards.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = shared.value.most - 1
        for _, texts, toxic in unpacked(batches):
            runs = ((k, own[a : a + CHUNK + gap], a + CHUNK + gap >= len(own)) for k, own in enumerate(texts) for a in range(0, max(1, len(own) - gap), CHUNK))
            z, lang = shared.value.judged(runs, len(texts))
            at = np.round(np.clip(z, -MOST, MOST) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at), pa.array(toxic)], names=["lang", "z", "toxic"])

    counted = shards.select("shard", "words", "sizes", "toxic").mapInArrow(run, "lang string, z long, toxic boolean").groupBy("lang", "z", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counted = counted.sort_values(["z", "toxic"])
    z, toxic, n = counted["z"].to_numpy(np.int64) * STEP, counted["toxic"].to_numpy(bool), counted["n"].to_numpy(np.float64)
    net.tested = int(n.sum())
    if not len(n) or toxic.all() or not toxic.any():
        return
    net.cut = best_cut(z, toxic, rate, n)
    for name in sorted(counted["lang"].dropna().unique()):
        own = (counted["lang"] == name).to_numpy(bool)
        if min(n[own & toxic].sum(), n[own & ~toxic].sum()) >= net.spec.language_texts:
            net.cuts[str(name)] = best_cut(z[own], toxic[own], rate, n[own])


def fit(docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang") -> Net:
    """Learns from all labels outside the held-out fold; languages from the ``lang_col`` of all documents outside it."""
    bad = F.udf(lambda b: int(np.frombuffer(b, bool).sum()), "long")
    with scratch():
        shards = packed(docs, labels, spec, id_col, text_col, label_col)
        counts = {r.tests: r for r in shards.groupBy("tests").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"), F.sum(bad("toxic")).alias("bad")).collect()}
        n, toxic = sum(r.n for r in counts.values()), sum(r.bad for r in counts.values())
        if toxic in (0, n):
            return Net(spec, np.zeros((1, spec.dim), np.float32), [], [], np.zeros(0, np.float32), flat=float(toxic > 0))
        learned = [counts[False]] if False in counts and 0 < counts[False].bad < counts[False].n else list(counts.values())  # few rows: all are trained on
        apart = len(learned) < len(counts)
        rows = sum(r.n for r in learned)
        net = trained(shards.filter(~F.col("tests")) if apart else shards, sum(r.shards for r in learned) == 1, rows, spec)
        net.trained = rows
        net.languages = tell_languages(docs, spec, id_col, text_col, lang_col) if lang_col else None
        if apart:
            calibrate(net, shards.filter("tests"), toxic / n)
    return net


def score(df: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared, spec = df.sparkSession.sparkContext.broadcast(net), net.spec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            s = shared.value.scores(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= spec.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = langid.crc_fold(F.col(id_col), spec.folds) == spec.held
    return df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, net: Net, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below the threshold, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < shared.value.spec.threshold))

    return df.mapInArrow(run, df.schema)
