"""Cross-tokenizer alignment against brute force; the toxicity classifier against a plain twin and by held-out accuracy."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shiori.llm import alignment, toxicity
from shiori.llm.toxicity import STEM, ToxicSpec

SCHEMA = "doc_id long, text string, lang string, source string, row long, pair int, docs long, toxic int"


def docs(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 7, 7, 7, 7) for i, t, lang in rows], SCHEMA)


# --- alignment

FILES = alignment.Tokenizers()
needs_files = pytest.mark.skipif(not os.path.isfile(FILES.byte_bpe), reason="tokenizer files are absent")
ODD = [None, "", " ", "\n\n  \t x", "a▁b", "<|endoftext|> and <s> </s> <unk>", "it's 2024!!", "naïve café", "é", "検索エンジンのテスト", "👩‍👩‍👧‍👦 🇩🇪", "\x00\x01", "a" * 3000, " " * 500 + "x", "ﬁ ½ ™", "𝄞" * 40, "tab\tsep"]


def brute_alignment(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of the texts, by the tokenizers' own encoders and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(FILES.byte_bpe)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=FILES.piece_bpe)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    aligned = []
    for text in texts:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            of_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
            of_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                own_a, own_b = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        at_a += len(of_a[i])
                        own_a.append(a[i])
                        i += 1
                    else:
                        at_b += len(of_b[j])
                        own_b.append(b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        aligned.append(groups)
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in aligned]
    counts = Counter(pair for own in links for pair in set(own))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups, own in zip(aligned, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), digest))
    return out


@needs_files
def test_alignment_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = ["the", "search", "engines", "über", "Straße", "año", "naïve", "XK-42", "3.14159", "検索", "don't", "\n", "  ", "q" * 30]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [texts[20]] * 3
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    df = docs(spark, rows).repartition(3)
    expected = sorted(map(repr, ((i, *r) for (i, _, _), r in zip(rows, brute_alignment(texts), strict=True))))

    def got(**more):
        return sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in alignment.align(df, **more).collect())

    assert got() == expected
    # With few pairs broadcast, and with none, the others meet their counts in a join.
    assert got(most_pairs=40) == expected and got(most_pairs=0) == expected


@needs_files
def test_alignment_in_small_parts(spark, monkeypatch):
    """Parts of a document each, and partial counts handed on at once."""
    texts = [t for t in ODD if t] * 2
    with open(FILES.byte_bpe, "rb") as a, open(FILES.piece_bpe, "rb") as b:
        own = alignment.Aligner(*alignment._loaded(a.read(), b.read()))
    expected = brute_alignment(texts)
    counts = Counter()
    for text, row in zip(texts, expected, strict=True):
        columns = [c.to_pylist() if hasattr(c, "to_pylist") else c.tolist() for c in own.align([text])]
        assert [c[0] for c in columns[:5]] == [*row[:4], row[6]] and sum(columns[6][0]) == row[3]
        if (full := own.partial(5)) is not None:
            counts.update(dict(zip(full.column(8).to_pylist(), full.column(9).to_pylist(), strict=True)))
    if (rest := own.partial(0)) is not None:
        for pair, n in zip(rest.column(8).to_pylist(), rest.column(9).to_pylist(), strict=True):
            counts[pair] += n
    assert sum(counts.values()) == sum(len(set(x)) for x in (own.align([t])[5].to_pylist()[0] for t in texts))


@needs_files
def test_alignment_of_no_rows_and_of_no_tokens(spark):
    assert alignment.align(docs(spark, [])).collect() == []
    got = alignment.align(docs(spark, [(1, None, "x"), (2, "▁", "x")])).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


@needs_files
def test_ranks_give_the_tokens_of_the_file():
    with open(FILES.byte_bpe, "rb") as a, open(FILES.piece_bpe, "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    assert pair.fast is not None
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab Z'st\n\t 09é文🙂 ́-_.") for _ in range(rng.randrange(80)))
        assert pair.fast.encode_ordinary(text) == pair.plain.encode(text, add_special_tokens=False).ids


# --- toxicity

LANGS = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["ción", "os", "el", "ña"]}
BAD = {"aa": ["zorv", "zorvka"], "bb": ["quexung", "quexei"], "cc": ["wañazo", "wañazel"]}


def labelled(n, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        own = ["".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(BAD[lang]))
        rows.append((i, " ".join(own), lang))
        labels.append((i, int(toxic)))
    return rows, labels


SMALL = ToxicSpec(labelled_rows=600, language_texts=5, buckets=1 << 12, steps=600)


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = labelled(1100)
    table = spark.createDataFrame([*labels, labels[3], (None, 1), (10_000, 1), (5, None)], "doc_id long, toxic int")
    return rows, dict(labels), toxicity.fit(docs(spark, [*rows, rows[3], (None, "zorv", "aa"), (2000, None, None)]), table, SMALL)


def test_toxicity_held_out(spark, learned):
    rows, truth, net = learned
    odd = [(None, "x", None), (2001, None, "aa"), (2002, "", None), (2003, " \n", "aa"), (2004, "!!", "bb"), rows[0]]
    df = docs(spark, rows + odd)
    got = toxicity.score(df, net).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hit = [r.predicted for r in held if truth[r.doc_id]]
    assert len(hit) > 20 and np.mean(hit) > 0.95 and np.mean([r.predicted for r in held if not truth[r.doc_id]]) < 0.02
    assert len({r.score for r in got if r.doc_id in (2001, 2002, 2003, 2004)}) == 1
    kept = toxicity.keep_clean(df, net)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.score(docs(spark, []), net).count() == 0


def test_thresholds_are_set_by_language(learned):
    _, _, net = learned
    assert set(net.cuts) == set(LANGS)
    # The threshold that errs least, at the rate of toxic labels: by hand.
    z, toxic = np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([False, True, False, True, True])
    assert toxicity.best_cut(z, toxic, 0.6) == pytest.approx(2.5) or toxicity.best_cut(z, toxic, 0.6) == pytest.approx(1.5)
    assert toxicity.best_cut(z, z > 2, 0.1) == pytest.approx(2.5)


def twin_pooled(net, text):
    """The net's pooled features of a text, window by window."""
    spec, mask = net.spec, (1 << 64) - 1

    def row(word, salt):
        h = sum(ord(c) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(word)) & mask
        h = (h ^ salt) * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 31
        h = h * 0x94D049BB133111EB & mask
        return (h >> 40) % (spec.buckets - 1) + 1

    words, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            now += c
        elif now:
            words.append(now)
            now = ""
    vectors = [net.table[row(w, 1)].astype(float) + net.table[row(w[:STEM], 2)] for w in words]
    zero = np.zeros(spec.dim)
    out = []
    for kernel, bias in zip(net.kernels, net.biases, strict=True):
        best = np.full(spec.filters, -np.inf)
        for i in range(max(1, len(vectors))):
            window = [vectors[i + k] if i + k < len(vectors) else zero for k in range(len(kernel))]
            best = np.maximum(best, sum(v @ kernel[k] for k, v in enumerate(window)) + bias)
        out.append(np.maximum(best, 0))
    return np.concatenate(out)


def test_toxicity_equals_its_twin(learned, monkeypatch):
    rows, _, net = learned
    texts = [t for _, t, _ in rows[:40]] + ["", None, "x", "Ünï ÇÖDÉ 𝄞 42", "a-b_c", "İstanbul", "y" * 50]
    expected = np.array([twin_pooled(net, t) for t in texts])
    assert np.allclose(net.pooled(texts), expected, atol=1e-4)
    # Long texts are taken in segments, with the same windows; words longer than a segment too.
    monkeypatch.setattr(toxicity, "SEGMENT", 40)
    assert np.allclose(net.pooled(texts), expected, atol=1e-4)


def test_toxicity_without_both_labels(spark):
    rows, _ = labelled(20)
    df = docs(spark, rows)
    for label, expected in ((0, 0.0), (1, 1.0), (None, 0.0)):
        table = spark.createDataFrame([(i, label) for i, *_ in rows], "doc_id long, toxic int")
        assert {r.score for r in toxicity.score(df, toxicity.fit(df, table, SMALL)).collect()} == {expected}


def test_toxicity_gradients():
    """Training lowers the loss of a fixed sample to near nothing."""
    rows, labels = labelled(200, seed=9)
    texts, toxic = [toxicity.words(t, SMALL.buckets)[0] for _, t, _ in rows], np.array([y for _, y in labels], float)
    net = toxicity.train(texts, toxic, ToxicSpec(buckets=1 << 12, word_dropout=0.0, feature_dropout=0.0, steps=2000))
    z = net.logits([t for _, t, _ in rows])
    assert np.mean((z > 0) == (toxic > 0)) > 0.98


def test_toxicity_learns_from_all_labels(spark):
    """Far more labelled rows than a shard holds: each is trained on or sets thresholds, whatever the partitions."""
    spec = ToxicSpec(labelled_rows=30, language_texts=5, buckets=1 << 12, epochs=2, steps=1, rounds=2)
    rows, labels = labelled(700, seed=3)
    table = spark.createDataFrame([*labels, labels[5]], "doc_id long, toxic int")
    df = docs(spark, [*rows, rows[5], rows[6]])
    hashes = {r.doc_id: r.h for r in df.select("doc_id", toxicity.unit_hash(spec.seed, df.doc_id).alias("h")).collect()}
    outside = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    learned = [t for i, t, _ in outside if hashes[i] % 4]
    net = toxicity.fit(df, table, spec)
    # Words are those of all texts that are trained on.
    seen = Counter(r for t in learned for r in set(toxicity.words(t, spec.buckets)[0].ravel().tolist()))
    assert set(np.flatnonzero(net.table.any(axis=1)).tolist()) == {r for r, n in seen.items() if n >= spec.least_docs}
    assert (net.trained, net.tested) == (len(learned), len(outside) - len(learned))
    # Languages are told by the words of all documents outside the fold, repeated rows too.
    assert net.languages.names == sorted(LANGS)
    counted = np.zeros((toxicity.LANGUAGE_ROWS, len(LANGS)))
    for _, t, lang in [*outside, *(r for r in rows[5:7] if r in outside)]:
        for row in toxicity.words(t, spec.buckets)[0].ravel():
            counted[row % (toxicity.LANGUAGE_ROWS - 1) + 1, sorted(LANGS).index(lang)] += 1
    expected = np.log((counted + 0.5) / (counted + 0.5).sum(axis=0))
    assert np.allclose(net.languages.logp[1:], expected[1:], atol=1e-5) and not net.languages.logp[0].any()
    told = net.judged(net._runs([t for _, t, _ in rows]), len(rows))[1]
    assert np.mean([a == b for a, (*_, b) in zip(told, rows, strict=True)]) > 0.99
    assert net.judged(net._runs([None, " "]), 2)[1] == [None, None]
    # The thresholds are those of all texts apart from these, to a step.
    truth, tests = dict(labels), [(i, t) for i, t, _ in outside if hashes[i] % 4 == 0]
    z, toxic = np.round(net.logits([t for _, t in tests]) / toxicity.STEP) * toxicity.STEP, np.array([truth[i] for i, _ in tests], bool)
    rate = np.mean([truth[i] for i, *_ in outside])
    assert net.cut == pytest.approx(toxicity.best_cut(z, toxic, rate), abs=2 * toxicity.STEP)
    again = toxicity.fit(df.repartition(7), table.repartition(5), spec)
    assert np.array_equal(again.table, net.table) and np.array_equal(again.out, net.out) and again.bias == net.bias
    assert (again.cut, again.cuts) == (net.cut, net.cuts)


def test_toxicity_of_long_texts(learned, monkeypatch):
    """Texts beyond the words that are held at once: the same features, peaks and places."""
    _, _, net = learned
    rng = random.Random(8)
    texts = [" ".join(rng.choice(LANGS["aa"]) + rng.choice(LANGS["bb"]) for _ in range(n)) for n in (0, 1, 5, 90, 400, 2)]
    rows = [toxicity.rows_of(t, net.spec) for t in texts]
    empty = np.zeros((3, toxicity.ROWS), np.int32)
    ids = np.concatenate([part for own in rows for part in (own, empty)])
    start = np.cumsum([0, *(len(own) + 3 for own in rows[:-1])])
    stop = start + [max(1, len(own)) for own in rows]
    whole, places = toxicity.peaks(net, ids, start, stop)
    pooled = net.pooled(texts)
    assert np.allclose(np.maximum(whole, 0), pooled, atol=1e-4)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    best, at = toxicity.peaks(net, ids, start, stop)
    assert np.allclose(best, whole, atol=1e-5) and np.mean(at == places) > 0.99
    assert np.allclose(net.pooled(texts), pooled, atol=1e-4)
    monkeypatch.setattr(toxicity, "SEGMENT", 50)
    assert all(np.array_equal(toxicity.rows_of(t, net.spec), own) for t, own in zip(texts, rows, strict=True))


def test_cut_between_equal_and_counted_logits():
    z, toxic = np.array([0.0, 1.0, 1.0, 2.0]), np.array([False, False, True, True])
    assert toxicity.best_cut(z, toxic, 0.5) == pytest.approx(1.5) or toxicity.best_cut(z, toxic, 0.5) == pytest.approx(0.5)
    assert toxicity.best_cut(z, toxic, 0.5, np.array([1.0, 9.0, 1.0, 9.0])) == pytest.approx(1.5)
    assert toxicity.best_cut(z, toxic, 0.5, np.array([9.0, 1.0, 9.0, 1.0])) == pytest.approx(0.5)
