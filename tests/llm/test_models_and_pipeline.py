"""Language models, quality ranker, n-gram join and the pipeline: brute force, held-out accuracy, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiori.llm import graph, langid, ngram_join, quality
from shiori.llm.common import unit_hash, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, parts string"
SYLLABLES = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["ción", "os", "el", "ña"]}
EDGES = [None, "", " \n\t", "1234 !?", "x", "Ünï çödé 𝄞"]


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def docs(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "n", "p") for i, t, lang, s in rows], DOCS)


# --- language identification


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    data = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        data.append((i, prose(rng, lang, rng.randrange(3, 60)), lang, "s"))
    data += [(1000 + i, t, None if i % 2 else "aa", "s") for i, t in enumerate(EDGES)] + [(None, prose(rng, "bb", 9), "bb", "s"), data[0], data[0]]
    return data


def test_langid_held_out(spark, tongues):
    df = docs(spark, tongues)
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == len(tongues)
    truth = {i: (t, lang) for i, t, lang, _ in tongues}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id][1] for r in held]) > 0.97
    for r in got:
        text = truth[r.doc_id][0]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    kept = langid.keep_identified(df, langid.fit(df))
    assert kept.columns == df.columns
    missing = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {r.doc_id for r in kept.collect()} >= set(range(300)) and not missing & {r.doc_id for r in kept.collect()}


def test_langid_without_labels(spark):
    df = docs(spark, [(1, "abc", None, "s"), (2, None, None, "s")])
    assert langid.fit(df) is None
    assert [(r.lang_pred, r.score) for r in langid.identify(df, None).collect()] == [("und", 0.0)] * 2
    assert langid.identify(docs(spark, []), None).count() == 0


def test_rejects_another_language(spark, tongues):
    df = docs(spark, tongues)
    model = langid.fit(df)
    far = "".join(random.Random(2).choice("qxzwvjfgyp ") for _ in range(800))
    assert [r for _, _, r, _ in langid.decide(model, [far, prose(random.Random(3), "aa", 80)])] == [True, False]


def test_kneser_ney_sums_to_one():
    rng = random.Random(4)
    counts = {}
    for lang in SYLLABLES:
        code, n = np.unique(np.concatenate([langid.codes(langid.symbols(prose(rng, lang, 40))) for _ in range(20)]), return_counts=True)
        counts[lang] = (code, n)
    model = langid.train(counts)
    contexts = [int(c) >> langid.BITS for c in counts["aa"][0][:5]] + [int(0x123456789)]
    for context in contexts:
        every = (np.uint64(context) << np.uint64(langid.BITS)) | np.arange(langid.SYMBOLS, dtype=np.uint64)
        assert np.exp(model.symbol_logp(every).astype(np.float64)).sum(axis=0) == pytest.approx(np.ones(3), abs=2e-3)


class Twin:
    """Interpolated Kneser-Ney of one language by dictionaries."""

    def __init__(self, texts):
        self.counts = [None] * (langid.ORDER + 1)
        grams = [tuple(run[i : i + langid.ORDER]) for run in (langid.symbols(t).tolist() for t in texts) for i in range(len(run) - langid.ORDER + 1)]
        level = Counter(grams)
        for n in range(langid.ORDER, 0, -1):
            self.counts[n] = level
            level = Counter(g[1:] for g in level)
        self.d, self.context = [None], [None]
        for level in self.counts[1:]:
            ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
            self.d.append(ones / (ones + 2 * twos) if ones and twos else 0.75)
            sums = {}
            for g, c in level.items():
                total, kinds = sums.get(g[:-1], (0, 0))
                sums[g[:-1]] = total + c, kinds + 1
            self.context.append(sums)

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / langid.SYMBOLS
        total, kinds = self.context[n].get(gram[:-1], (0, 0))
        if not total:
            return self.p(gram[1:])
        return max(self.counts[n].get(gram, 0) - self.d[n], 0) / total + self.d[n] * kinds / total * self.p(gram[1:])


def test_model_equals_its_twin():
    """Probability by probability and prediction by prediction, over texts of known, mixed and unknown letters."""
    rng = random.Random(21)
    texts = {lang: [prose(rng, lang, 40) for _ in range(30)] for lang in SYLLABLES}
    counts = {k: np.unique(np.concatenate([langid.codes(langid.symbols(t)) for t in v]), return_counts=True) for k, v in texts.items()}
    model, twins = langid.train(counts), {k: Twin(v) for k, v in texts.items()}
    tried = [prose(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 30)) for _ in range(40)] + [prose(rng, "aa", 4) + prose(rng, "bb", 5), "qxz wvj", "Ü", "漢字 かな", "k"]
    for text, (lang, score, _, entropy) in zip(tried, langid.decide(model, tried), strict=True):
        run = langid.symbols(text).tolist()
        grams = [tuple(run[i : i + langid.ORDER]) for i in range(len(run) - langid.ORDER + 1)]
        expected = np.array([[np.log(twins[k].p(g)) for k in model.languages] for g in grams])
        assert np.allclose(model.symbol_logp(langid.codes(langid.symbols(text))), expected, atol=1e-4)
        total = expected.sum(axis=0)
        assert lang == model.languages[int(np.argmax(total))]
        assert entropy == pytest.approx(-total.max() / len(grams) / np.log(2), rel=1e-4)
        assert score == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-3)


def test_sample_is_bounded_and_of_the_least_hashes(spark):
    rows = [(i, "x", "aa" if i % 10 else "bb", "s") for i in range(3000)] + [(5, "x", "aa", "s")] * 2000
    got = langid.sample(docs(spark, rows), langid.LangSpec(docs_per_language=200), "doc_id", "text", "lang").collect()
    n = Counter(r.lang for r in got)
    assert n == {"aa": 200, "bb": 200}
    hashed = {r.doc: r.h for r in spark.range(3000).select(F.col("id").alias("doc"), unit_hash(41, F.col("id")).alias("h")).collect()}
    for lang, ids in (("aa", [i for i in range(3000) if i % 10]), ("bb", range(0, 3000, 10))):
        learned = sorted((i for i in ids if zlib.crc32(str(i).encode()) % 5), key=hashed.get)
        assert {r.doc for r in got if r.lang == lang} == set(learned[:200])
    few = langid.sample(docs(spark, rows), langid.LangSpec(docs_per_language=5000), "doc_id", "text", "lang")
    assert few.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3000))


def test_long_text_in_pieces(spark, tongues):
    model = langid.fit(docs(spark, tongues))
    text = prose(random.Random(8), "bb", 150_000)
    n, total, passages = langid.measure(model, [text, None, "ei"])
    values = model.symbol_logp(langid.codes(langid.symbols(text))).astype(np.float64)
    assert n[0] == len(values) and total[0] == pytest.approx(values.sum(axis=0), rel=1e-6)
    assert passages[0] == pytest.approx(np.add.reduceat(values, np.arange(0, len(values), langid.PASSAGE)).max(axis=1).sum(), rel=1e-6)
    assert n[1] == 0 and n[2] > 0


def test_two_languages_in_one_text(spark, tongues):
    """The language of the larger part wins, and the text is not rejected."""
    model = langid.fit(docs(spark, tongues))
    rng = random.Random(5)
    got = langid.decide(model, [prose(rng, "bb", 60) + " " + prose(rng, "cc", 30), prose(rng, "cc", 60) + ". " + prose(rng, "aa", 30)])
    assert [(lang, rejected) for lang, _, rejected, _ in got] == [("bb", False), ("cc", False)]


def test_rejects_short_junk_beside_a_long_outlier(spark, tongues):
    """One long document of junk that calibrates sets no limit; limits do not grow with length."""
    junk = " ".join("".join(random.Random(9 + i).choice("qxzwvjfgyp") for _ in range(5)) for i in range(4000))
    tried = docs(spark, [(7000 + i, "x", "aa", "s") for i in range(40)])
    outlier = next(r.doc for r in langid.sample(tried, langid.LangSpec(), "doc_id", "text", "lang").collect() if r.calibrates)
    model = langid.fit(docs(spark, [*tongues, (outlier, junk, "aa", "s")]))
    rng = random.Random(10)
    short = ["".join(rng.choice("qxzwvjfgyp ") for _ in range(n)).strip() + "q" for n in (8, 16, 30, 60) for _ in range(5)]
    clean = [prose(rng, lang, n) for lang in SYLLABLES for n in (4, 8, 30, 900)]
    assert [r for _, _, r, _ in langid.decide(model, [*short, junk, *clean])] == [True] * (len(short) + 1) + [False] * len(clean)
    assert np.isfinite(model.limits).all() and (np.diff(model.limits, axis=1) <= 0).all()


def test_language_that_nothing_calibrates(spark):
    """Too few documents to calibrate on: only letterless texts are rejected."""
    rows = langid.sample(docs(spark, [(i, "x", "aa", "s") for i in range(40)]), langid.LangSpec(), "doc_id", "text", "lang").collect()
    counted = next(r.doc for r in rows if not r.calibrates)
    model = langid.fit(docs(spark, [(counted, prose(random.Random(1), "aa", 50), "aa", "s")]))
    assert model.limits is None and [r for _, _, r, _ in langid.decide(model, ["qxz wv", "12", None])] == [False, True, True]


# --- quality


def test_quality_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, "aa", rng.randrange(20, 90)).capitalize() + "."
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60), text.replace(" ", "### ")])
        rows.append((i, text, "aa", "s"))
        labels.append((i, int(good), 0))
    rows += [(5000 + i, t, None, "s") for i, t in enumerate(EDGES)] + [(None, "a b c", "aa", "s"), rows[0]]
    labels += [(5000, 0, 0), (None, 1, 0), (7, None, 0), labels[0], labels[0]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    ranker = quality.fit(df, table)
    got = quality.score(df, ranker).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = quality.keep_good(df, ranker)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(df.limit(0), ranker).count() == 0


def quality_rows(n=500):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = prose(rng, "aa", rng.randrange(5, 60)).capitalize() + "."
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60), text.replace(" ", "### "), text[: len(text) // 3]])
        rows.append((i, text, "aa", "s"))
        labels.append((i, int(good if rng.random() < 0.95 else not good)))
    return rows, labels


def test_quality_equals_its_twin(spark):
    """Scores against gradient ascent on the same Bradley-Terry pairs, written out pair by pair, and a threshold found by trying all."""
    rows, labels = quality_rows()
    spec = quality.QualitySpec(pairs=3000)
    df, table = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, table, spec), spec).collect()}
    learned = [(i, q) for i, q in sorted(labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    text = {i: t for i, t, *_ in rows}
    x = np.array([quality.features(text[i]) for i, _ in learned])
    good = np.array([q == 1 for _, q in learned])
    low, high = np.quantile(x, 0.001, axis=0), np.quantile(x, 0.999, axis=0)
    mean, dev = np.clip(x, low, high).mean(axis=0), np.maximum(np.clip(x, low, high).std(axis=0), 1e-6)

    def inputs(v):
        z = (np.clip(v, low, high) - mean) / dev
        return np.hstack([z, z**2])

    z = inputs(x)
    rng = np.random.default_rng(spec.seed)
    pairs = list(zip(rng.choice(np.flatnonzero(good), spec.pairs), rng.choice(np.flatnonzero(~good), spec.pairs), strict=True))
    diff = np.array([z[a] - z[b] for a, b in pairs])
    w, rate = np.zeros(z.shape[1]), 0.9 / (np.linalg.norm(diff, 2) ** 2 / len(diff) / 4 + 1e-3)
    seen = w
    for k in range(60000):  # accelerated: a step from a point beyond the last one
        step = diff.T @ (1 / (1 + np.exp(diff @ seen))) / len(diff) - 1e-3 * seen
        new = seen + rate * step
        seen, w = new + k / (k + 3) * (new - w), new
        if np.abs(step).max() < 1e-9:
            break
    worth = z @ w
    candidates = sorted(worth)
    edges = [candidates[0] - 1, *((a + b) / 2 for a, b in zip(candidates, candidates[1:], strict=False)), candidates[-1] + 1]
    wrong = [sum((v > e) != g for v, g in zip(worth, good, strict=True)) for e in edges]
    best = [k for k, v in enumerate(wrong) if v == min(wrong)]
    at = best[len(best) // 2]
    cut = edges[at] if 0 < at < len(candidates) else edges[at] / 2 + candidates[0 if at == 0 else -1] / 2
    scale = np.median(np.abs(worth - cut)) / 2
    for i, t in text.items():
        s = 1 / (1 + np.exp(-((inputs(np.array([quality.features(t)])) @ w)[0] - cut) / scale - np.log(0.7 / 0.3)))
        assert got[i] == pytest.approx(s, abs=2e-3)


def test_quality_learns_from_its_labels_alone(spark):
    """Flipped labels turn the order round; held-out labels, languages, sources and ids change nothing."""
    rows, labels = quality_rows(300)
    df = docs(spark, rows)

    def scores(labels, df=df):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        return [r.score for r in sorted(quality.score(df, quality.fit(df, table)).collect(), key=lambda r: r.doc_id)]

    base = scores(labels)
    flipped = scores([(i, 1 - q) for i, q in labels])
    assert np.corrcoef(base, flipped)[0, 1] < -0.9
    learned = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert scores(learned) == pytest.approx(base, abs=1e-9)
    assert scores([(i, q if (i, q) in learned else 1 - q) for i, q in labels]) == pytest.approx(base, abs=1e-9)
    assert scores(labels, docs(spark, [(i, t, "zz", f"other{i}") for i, t, *_ in rows])) == pytest.approx(base, abs=1e-9)


def test_quality_with_one_label(spark):
    df = docs(spark, [(i, "a b", "aa", "s") for i in range(9)])
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.fit(df, one)).collect()} == {0.7}
    assert quality.score(df, quality.fit(df, one.limit(0))).count() == 9


# --- components and the n-gram join


def closure(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(-5, 7), (7, 7), (3, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = closure(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in label.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)) if w else frozenset()


def brute(data, n, percent):
    """component of each row number, by all pairs."""
    grams = [sets(t, n) for _, t, *_ in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if grams[i] and grams[j] and 100 * len(grams[i] & grams[j]) >= percent * len(grams[i] | grams[j])]
    label = closure(pairs, range(len(data)))
    ids = {}
    for i, k in label.items():
        if data[i][0] is not None:
            ids[k] = min(ids.get(k, data[i][0]), data[i][0])
    return grams, {i: ids.get(k) for i, k in label.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    data = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 5, 9, 19, 40, 90)))]
        if rng.random() < 0.4:
            base = shared + base
        for _ in range(rng.choice((1, 2, 6))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            data.append((len(data), " ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper(), "en", "s"))
    data += [(900 + i, t, None, None) for i, t in enumerate(EDGES)] + [(None, data[3][1], "en", "s"), (None, "only null", "en", "s"), data[5], data[5]]
    return data


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_join_against_all_pairs(spark, n, percent, seed, monkeypatch):
    data = corpus(seed)
    grams, component = brute(data, n, percent)
    expected = sorted(repr((d[0], len(grams[i]), component[i] if grams[i] else d[0])) for i, d in enumerate(data))
    got = ngram_join.join_components(docs(spark, data), n=n, percent=percent).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == expected
    assert len([r for r in got if r.leads and r.n_shingles]) >= len({c for i, c in component.items() if grams[i]})


def test_join_in_blocks(spark, monkeypatch):
    """Large families go through the hub and the tiles: here with blocks of two nodes."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 2)
    monkeypatch.setattr(ngram_join, "FAMILY_NODES", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 60)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 3)
    monkeypatch.setattr(ngram_join, "GROUP_NODES", 4)
    monkeypatch.setattr(ngram_join, "BIG_GROUP", 1)
    data = corpus(7)
    grams, component = brute(data, 3, 80)
    got = ngram_join.join_components(docs(spark, data), n=3, percent=80).collect()
    expected = sorted(repr((d[0], len(grams[i]), component[i] if grams[i] else d[0])) for i, d in enumerate(data))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == expected


def test_order_of_ngrams_never_decides(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_IN_BATCH", 2)
    data = corpus(11)
    grams, component = brute(data, 3, 90)
    got = ngram_join.join_components(docs(spark, data).repartition(3), n=3, percent=90).collect()
    assert sorted(repr((r.doc_id, r.component_id)) for r in got) == sorted(repr((d[0], component[i] if grams[i] else d[0])) for i, d in enumerate(data))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, max(1, len(a) * 4 // 5), replace=False), rng.integers(0, 2**64, rng.integers(0, 40), dtype=np.uint64))))
        both = ngram_join.Sketches(np.array([len(a), len(b)]), [ngram_join.parities(a), ngram_join.parities(b)])
        linked = ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b), 80)
        assert both.compatible(np.array([0]), np.array([1]), 80)[0] or not linked


@pytest.mark.parametrize("percent,big", [(84, 512), (85, 512), (90, 4)])
def test_just_below_and_above_the_bound(spark, monkeypatch, percent, big):
    """Pairs of one n-gram more and one less than the bound demands, of many sizes; a family around each bound."""
    monkeypatch.setattr(ngram_join, "BIG_GROUP", big)
    rng, data, expected = random.Random(percent), [], {}
    for k in range(160):
        a = rng.randrange(3, 260)
        b = rng.randrange(max(1, a * percent // 100), a * 100 // percent + 1)
        least = -(-percent * (a + b) // (100 + percent))
        for over in (0, 1):
            both = least - over
            if both > min(a, b):
                continue
            words = [f"w{k}x{over}n{i}" for i in range(a + b)]
            i = len(data)
            one, two = words[:a], words[:both] + words[a : a + b - both]
            rng.shuffle(one)
            rng.shuffle(two)
            data += [(i, " ".join(one), "aa", "s"), (i + 1, " ".join(two), "aa", "s")]
            expected[i], expected[i + 1] = i, i + over
    base = [f"t{i}" for i in range(100)]
    for m in range(60):  # a common text with words of one's own: alike by turns just enough and not quite
        own = base[: 100 - m % 12] + [f"o{m}n{i}" for i in range(m % 12)]
        data.append((10_000 + m, " ".join(own), "aa", "s"))
    family = data[-60:]
    component = closure([(x[0], y[0]) for i, x in enumerate(family) for y in family[:i] if ngram_join.linked(len({*x[1].split()} & {*y[1].split()}), 100, 100, percent)], [x[0] for x in family])
    expected |= component
    got = ngram_join.join_components(docs(spark, data), n=1, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_near_pairs_equal_the_comparison_of_each_pair(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    monkeypatch.setattr(ngram_join, "SLICE", 32)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for percent in (40, 80, 90):
        sets = [np.unique(np.concatenate((rng.choice(base[:k], k * 9 // 10, replace=False), rng.integers(0, 2**64, rng.integers(0, 12), dtype=np.uint64)))) for k in rng.integers(20, 400, 60)]
        sizes, bins = np.array([len(g) for g in sets]), [ngram_join.parities(g) for g in sets]
        got = {(min(x), max(x)) for i, j in ngram_join.near_pairs(sizes, bins, percent) for x in zip(i.tolist(), j.tolist(), strict=True)}
        sketches = ngram_join.Sketches(sizes, bins)
        every = np.array([(i, j) for j in range(60) for i in range(j)])
        ok = sketches.compatible(every[:, 0], every[:, 1], percent)
        missed = {(int(i), int(j)) for (i, j), k in zip(every, ok, strict=True) if k} - got
        assert not any(ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], percent) for i, j in missed)
        if percent > 50:
            assert not missed and got == {(int(i), int(j)) for (i, j), k in zip(every, ok, strict=True) if k}


@pytest.mark.parametrize("dense,listed", [(64, 1 << 22), (1, 50), (10**9, 10)])
def test_product_counts(monkeypatch, dense, listed):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    monkeypatch.setattr(ngram_join, "SLICE", 5)
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(23)]
    got = ngram_join.overlaps(rows[:9], rows[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in rows[5:]] for a in rows[:9]]
    assert ngram_join.overlaps(rows[:2], [np.array([99], np.uint64)]).tolist() == [[0], [0]]


def test_keep_one(spark):
    data = corpus(5)
    grams, component = brute(data, 5, 80)
    df = docs(spark, data)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    expected = [i for k, (i, *_) in enumerate(data) if not grams[k]] + sorted({c for k, c in component.items() if grams[k] and c is not None}) + [None]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert ngram_join.keep_one(docs(spark, [])).count() == 0


def test_ngram_repeated_row_with_a_near_copy(spark, monkeypatch):
    """A row repeated 3,000 times lends its text once."""
    text = " ".join(f"w{i}" for i in range(200))
    data = [(1, text, "aa", "s")] * 3000 + [(2, text + " ka", "aa", "s"), (3, prose(random.Random(6), "bb", 50), "bb", "s")]
    seen, whole = {}, ngram_join.written

    def counting(df, name):
        out = whole(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counting)
    df = docs(spark, data).repartition(4)
    got = {(r.doc_id, r.component_id) for r in ngram_join.join_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}, seen
    assert seen.get("ngram-texts") == 2, seen
    kept = ngram_join.keep_one(df, n=3, percent=90)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == df.columns


# --- pipeline


def digits(seed, *parts):
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)


def brute_mix(docs):
    """Rows (id, text) of the mix: water-filling source by source, whole repetitions, and a last one up to a word."""
    cut = re.compile("[^ \t-\r]+").findall
    of = {}
    for i, t, s in docs:
        of.setdefault(s, []).append((digits(17, i, len(cut(t))), i, len(cut(t)), t))
    sizes = {s: sum(x[2] for x in rows) for s, rows in of.items()}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if over else weight[s] * level for s in over or free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = []
    for s, rows in of.items():
        whole = int(target[s] // sizes[s])
        rest = int(target[s] - whole * sizes[s])
        for _, i, n, t in sorted(rows):
            out += [(i, t)] * whole
            if rest >= n:
                out.append((i, t))
            elif rest > 0:
                out.append((i, " ".join(cut(t)[:rest])))
            rest -= min(n, max(rest, 0))
    return out


def brute_shards(docs):
    """(id, size, crc, shard, slot) of six old shards cut for eight: what stays first, then the line of the rest."""
    seen, rows = Counter(), []
    for i, t in docs:
        key = i, zlib.crc32(t.encode()), len(t.encode()) + 1
        rows.append((digits(30, i) % 6, digits(29, i, key[1], seen[key]), *key))
        seen[key] += 1
    total = sum(r[4] for r in rows)
    cap = [total // 8 + (j < total % 8) for j in range(8)]
    small = max(1, total // (8 * 4096))
    size = [sum(r[4] for r in rows if r[0] == k) for k in range(6)]
    stay = [min(size[k], cap[k]) for k in range(6)]
    placed, line = [], []
    for k in range(6):
        at = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[4] <= small, r[1:])):
            if at + r[4] * (1 - (k + 0.5) / 6) < stay[k]:
                placed.append((k, r))
            else:
                line.append(r)
            at += r[4]
    lacks = [(j, cap[j] - (stay[j] if j < 6 else 0)) for j in range(8) if cap[j] > (stay[j] if j < 6 else 0)]
    tails, needed, at = sum(r[4] for r in line), sum(x for _, x in lacks), 0
    for r in line:
        top = 0
        for j, x in lacks:
            top += x
            if at + r[4] / 2 < top * tails / needed or (j, x) == lacks[-1]:
                placed.append((j, r))
                break
        at += r[4]
    return [(r[2], r[4], r[3], j, slot) for j in range(8) for slot, r in enumerate(sorted((r for k, r in placed if k == j), key=lambda r: r[1:]))]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows, no column n_chars, null ids and texts, repeated rows, more columns."""
    more = ["copy", "slot", "_id", "_th", "_id2", "_th2", "id", "th", "id2", "th2", "input", "_s", "_whole", "_size", "_key", "_cut", "_need", "_part", "place", "size", "h", "node", "doc", "_k", "_file", "_row", "parts", "bins"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in more)
    rng = random.Random(3)
    rows = [(i if i % 9 else None, prose(rng, "aa", 30), "aa", "s" if i % 3 else None, *more) for i in range(60)]
    rows += [rows[1]] * 3 + [(100, None, None, None, *[None] * len(more)), (101, "", "aa", "s", *more), (102, "??", "aa", "s", *more)]
    item = spark.createDataFrame([(1, None), (None, "??")], "item_id long, text string")
    for name, data in (("empty", []), ("odd", rows)):
        sf = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        item.write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        ids = Counter(r.doc_id for r in got)
        assert ids.keys() <= {r[0] for r in rows} - {100, 101, 102} and bool(got) == bool(data)
        for k in range(8):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    item = "the quick brown fox jumps over a lazy dog again and again"
    data = [(i, prose(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 80)), None, f"s{i % 7}") for i in range(200)]
    data = [(i, t, next(k for k, v in SYLLABLES.items() if any(t.startswith(x) for x in v)), s) for i, t, _, s in data]
    copies = [(300 + i, data[i][1] + " ka", data[i][2], "s1") for i in range(10) if len(data[i][1].split()) > 50]
    leaks = [(400 + i, data[i][1] + " " + item + " " + data[i + 50][1], data[i][2], "s2") for i in range(5)]
    junk = [(500, "12345 !!", "aa", "s3"), (501, None, "aa", "s3"), (502, "", None, None)]
    everything = data + copies + leaks + junk
    sf = f"file://{tmp_path}"
    docs(spark, everything).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [], table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = written(stage(spark, table, sf), name)
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
        if name == "mixing":
            mix = table
        if name != "sharding":
            assert table.columns == columns
    identified, single, clean, mixed, sharded = kept
    assert identified == {i for i, *_ in everything} - {500, 501, 502}
    _, component = brute(everything, 5, 80)
    lead = {i: component[k] for k, (i, *_) in enumerate(everything)}
    assert single == {i for i in identified if lead[i] == i} and not {i for i, *_ in copies} & single
    assert clean == single - {i for i, *_ in leaks}
    assert mixed == sharded and mixed <= clean
    # The mix and the shards, from what the stage before has kept, by hand.
    expected = brute_mix([(i, t, s) for i, t, _, s in everything if i in clean])
    assert sorted((r.doc_id, r.text) for r in mix.collect()) == sorted(expected)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in table.collect()) == sorted(brute_shards(expected))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, table.collect()))
    assert {r.shard for r in got.collect()} == set(range(8))
    assert corpus_pipeline.ORACLE_SQL is None
