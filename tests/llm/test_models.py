import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import hmm, language_id, quality, toxicity
from quillstone.llm.queries import QUERIES

CATEGORIES = ["low_quality", "toxic"]


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


def crc(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


def test_language_accuracy_on_held_out_texts(spark, big):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, big).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97


def test_language_of_odd_rows(odd, none, docs):
    model = language_id.train(docs)
    got = language_id.identify(odd, model)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    for r in got.collect():
        assert (r["language"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language_id.identify(none).count() == 0
    nothing = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("language.*").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]


def test_language_does_not_read_held_out_labels(docs):
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert np.array_equal(language_id.train(docs).weights, language_id.train(wrong).weights)


def plain_ngrams(text):
    """Byte n-grams of 2 to 4 of a window's letters; all other ASCII counts as a space."""
    raw = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in (b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    return {raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)}


def solved(a, b):
    """Gauss elimination with pivots, row by row."""
    a = [list(row) + list(right) for row, right in zip(a, b)]
    for i in range(len(a)):
        p = max(range(i, len(a)), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(len(a)):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [[x / row[i] for x in row[len(a) :]] for i, row in enumerate(a)]


def test_kernel_and_ridge_equal_plain_loops():
    """Kernels from sets of n-grams, every landmark, one-versus-rest ridge; few n-grams, so that none share a cell."""
    rows = [("en", "the cat and the dog"), ("en", "a dog and a cat"), ("de", "der hund und die katz"), ("de", "die katz der hund"), ("fr", "le chat et le chien")]
    model = language_id.fit(rows, landmarks=5)
    rows = sorted(rows)
    sets, languages = [plain_ngrams(t) for _, t in rows], ["de", "en", "fr"]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = [[kernel(a, b) for b in sets] for a in sets]
    n = len(rows)
    y = [[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows]
    a = [[sum(k[r][i] * k[r][j] for r in range(n)) + language_id.RIDGE * n * k[i][j] + 1e-6 * n * (i == j) for j in range(n)] for i in range(n)]
    c = solved(a, [[sum(k[r][i] * y[r][j] for r in range(n)) for j in range(3)] for i in range(n)])
    texts = ["the dog", "und die hund", "chat chien", "zzz"]
    for t, (lang, score) in zip(texts, model.predict(texts)):
        own = [kernel(plain_ngrams(t), s) for s in sets]
        f = [sum(own[i] * c[i][j] for i in range(n)) for j in range(3)]
        p = [min(1, max(0, (x + 1) / 2)) + 1e-9 for x in f]
        assert lang == languages[p.index(max(p))] and math.isclose(score, max(p) / sum(p), rel_tol=1e-3)


def test_sample_of_languages_is_bounded(spark):
    """Null and repeated ids, equal texts, and places anywhere in long texts."""
    seen = []
    rows = [(None, f"le texte {i} " * 3, "fr") for i in range(300)] + [(4, "one text again", "en")] * 300 + [(i, "x" * 2500 + " und am ende", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = language_id.fit
    try:
        language_id.fit = lambda r, **how: seen.append(sorted(r)) or fit(r, **how)
        language_id.train(df, per_language=50)
        language_id.train(df.repartition(7), per_language=50)
    finally:
        language_id.fit = fit
    counts = collections.Counter(lang for lang, _ in seen[0])
    assert seen[0] == seen[1] and counts["fr"] == 50 and counts["en"] <= 1 and 0 < counts["de"] <= 50
    assert any(t.endswith("ende") for lang, t in seen[0] if lang == "de")


def test_kernel_is_presence_over_norms():
    x, owner = language_id.presence([b"abab", b"", b"a" * 5000])
    assert owner.tolist() == [0, 1, 2, 2, 2] and not x[1].any()
    assert x[0].sum() == 2 + 2 + 1  # ab ba, aba bab, abab
    assert x[2].sum() == 3 and x[4].sum() == 3


def auc(pairs):
    one, zero = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(one, zero)])


def plain_ftrl(examples, passes, alpha, l1, l2, beta=1.0, positive=1.0):
    """Per-coordinate updates in dictionaries: features {cell: value}, label; the bias is the cell None."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(c):
        own = 0.0 if c is None else l1
        return 0.0 if abs(z[c]) <= own else -(z[c] - math.copysign(own, z[c])) / ((beta + math.sqrt(n[c])) / alpha + l2)

    for _ in range(passes):
        for features, label in examples:
            x = {**features, None: 1.0}
            w = {c: weight(c) for c in x}
            p = 1 / (1 + math.exp(-sum(w[c] * v for c, v in x.items())))
            for c, v in x.items():
                g = (p - label) * (positive if label else 1.0) * v
                s = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha
                z[c] += g - s * w[c]
                n[c] += g * g
    return {c: weight(c) for c in list(z)}


def plain_words(text, letters=False):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    if letters:
        low = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in low)
    return [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", low) if w]


def shape_words(text):
    kind = bytes(97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in (text or "").encode())
    return [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", bytes(b for i, b in enumerate(kind) if not i or kind[i - 1] != b)) if w]


def windows_of(words, n):
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def test_quality_equals_plain_updates_and_sums(spark):
    """Features from plain n-grams (cells by place in a list, none shared), updates in dictionaries, weights averaged over shards."""
    rng = np.random.default_rng(2)
    words = ["good", "Fine", "bad", "poor", "text", "page", "7", "x-y"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(60)]
    labels = [(i, int("good" in t)) for i, t in rows if i % 4]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    shards = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("s")).collect()}

    def cells(t):
        # a text of one word gives the same run for one and two words, as features of their own
        c = collections.Counter()
        for kind, ws in (("w", plain_words(t)), ("s", shape_words(t))):
            for n in (1, 2):
                c.update((kind, n, g) for g in windows_of(ws, n))
        return c

    text, quality_of = dict(rows), dict(labels)
    own = collections.defaultdict(list)
    for i in sorted((i for i in quality_of if crc(i, 5) != 0), key=lambda i: (zlib.crc32(b"order" + str(i).encode()), i)):
        c = cells(text[i])
        own[shards[i]].append(({x: float(np.float32(n / math.sqrt(sum(c.values())))) for x, n in c.items()}, quality_of[i]))
    total, mean = sum(map(len, own.values())), collections.defaultdict(float)
    for examples in own.values():
        for x, w in plain_ftrl(examples, 3, 0.3, 0.01, 0.1).items():
            mean[x] += w * len(examples) / total
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, known, shards=3).collect()}
    for i, t in rows:
        c = cells(t)
        x = sum(mean[k] * n for k, n in c.items()) / math.sqrt(max(1, sum(c.values()))) + mean[None]
        assert math.isclose(got[i], 1 / (1 + math.exp(-x)), abs_tol=1e-4), i


def test_chain_equals_plain_updates_with_folds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 6))), int(i % 3 == 0)) for i in range(80)]
    rows = [(i, t, low, int("alpha" in t and low)) for i, t, low in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("f")).collect()}
    learned = sorted((i for i, *_ in rows if crc(i, 5) != 0), key=lambda i: (zlib.crc32(b"order" + str(i).encode()), i))
    text, labels = {r[0]: r[1] for r in rows}, {"low_quality": {r[0]: r[2] for r in rows}, "toxic": {r[0]: r[3] for r in rows}}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def features(i, models, before):
        """Words, and the probabilities of earlier categories by the models of the row's fold."""
        x = {w: 1.0 for w in plain_words(text[i], letters=True)}
        for name in before:
            m = models[name][folds[i]] if i in learned else models[name][2]
            x[name] = sigmoid(sum(m.get(c, 0.0) * v for c, v in {**x, None: 1.0}.items()))
        return x

    models = {}
    for k, name in enumerate(CATEGORIES):
        given = {i: features(i, models, CATEGORIES[:k]) for i in learned}
        fit = lambda ids: plain_ftrl([(given[i], labels[name][i]) for i in ids], 4, 0.5, 0.3, 0.1, positive=toxicity.POSITIVE)  # noqa: B023, E731
        models[name] = {f: fit([i for i in learned if folds[i] != f]) for f in (0, 1, 2)}
    ftrl = toxicity.Ftrl
    monkeypatch.setattr(toxicity, "Ftrl", lambda size, alpha, l1, l2: ftrl(size, alpha=alpha, l1=0.3, l2=l2))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", *CATEGORIES), CATEGORIES, folds=2).collect()}
    for i in text:
        x = {w: 1.0 for w in plain_words(text[i], letters=True)}
        for name in CATEGORIES:
            m = models[name][2]
            x[name] = sigmoid(sum(m.get(c, 0.0) * v for c, v in {**x, None: 1.0}.items() if c != name))
            assert math.isclose(got[i][name], x[name], abs_tol=2e-3), (i, name)


def test_samples_are_bounded(spark):
    """Exactly the bound, whatever repeats; one row of a repeated id; nothing drawn twice."""
    from quillstone.llm import linear

    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality").union(spark.range(100).selectExpr("7L", "0")).union(spark.range(50).selectExpr("CAST(NULL AS LONG)", "1"))
    held = lambda d: F.lit(False)
    some = linear.labelled_sample(labels, ["quality"], held, 100)
    assert some.count() == 100 and some.distinct().count() == 100 and linear.labelled_sample(labels, ["quality"], held, 10**6).count() == 5000
    docs = spark.createDataFrame([(1, "b"), (1, "a a"), (1, None), (2, None)], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: len(r["index"]) for r in linear.sampled_features(docs, chosen, linear.Features()).collect()}
    assert got == {1: 1, 2: 0}


def test_quality_on_held_out_texts(spark, big):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, big).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in rows)
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]) > 0.8


def test_quality_of_odd_rows(odd, none, docs, labels):
    assert quality.score(odd, labels).count() == odd.count() and quality.score(none, labels).count() == 0
    untrained = quality.score(odd, labels.limit(0)).select("quality_score").distinct().collect()
    assert [r[0] for r in untrained] == [0.5]
    known = labels.union(labels).union(labels.select(F.lit(None).cast("long"), "quality", "toxic"))
    assert quality.score(docs, known).where("quality_score IS NULL").isEmpty()


def test_toxicity_finds_planted_texts_and_leaves_clean_ones(spark):
    words = [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([*rng.choice(words, 40), *(["scoundrel"] if i % 5 == 0 else [])]), int(i % 7 == 0), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    got = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", *CATEGORIES), CATEGORIES).join(df, "doc_id").collect()
    held = [r for r in got if crc(r["doc_id"], 5) == 0]
    assert len(held) > 50 and np.mean([r["toxic_pred"] == r["toxic"] for r in held]) > 0.99


def test_chain_feeds_earlier_categories(spark):
    """The second category is the first one: only the chain's weight tells it where its own words do not."""
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", i % 2, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    _, _, chain = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", *CATEGORIES), CATEGORIES)
    assert chain.shape == (2, 2) and chain[1, 0] > 0 and chain[0].sum() == 0


def test_toxicity_of_odd_rows(odd, none, labels):
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    assert toxicity.score(odd, known, CATEGORIES).where("toxicity.toxic BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score(none, known, CATEGORIES).count() == 0
    untrained = toxicity.score(odd, known.limit(0), CATEGORIES).select("toxicity.toxic").distinct().collect()
    assert [r[0] for r in untrained] == [0.5]


def paths(model, classes):
    """Likelihood by summing over all paths of states."""
    k = len(model.start)
    total = 0.0
    for path in itertools.product(range(k), repeat=len(classes)):
        p = model.start[path[0]] * model.emit[path[0], classes[0]]
        for a, b, c in zip(path, path[1:], classes[1:]):
            p *= model.move[a, b] * model.emit[b, c]
        total += p
    return total


def small_model(k=2, c=3):
    rng = np.random.default_rng(0)
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(normal(rng.random(k)), normal(rng.random((k, k))), normal(rng.random((k, c))), np.ones(c), np.ones(c))


def test_forward_is_exact_across_segments(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 3)
    monkeypatch.setattr(hmm, "WHOLE", 4)
    m, sequences = small_model(), [[0, 1, 2, 1, 0, 2, 2, 1], [2], [1, 0, 0], [0, 0, 1, 2]]
    got = m.forward(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    assert np.allclose(got, [math.log10(paths(m, s)) for s in sequences])


def path_counts(model, classes):
    """Expected counts of start, move and emit, and the likelihood, by going through all paths of states."""
    k, c = model.emit.shape
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0
    for path in itertools.product(range(k), repeat=len(classes)):
        p = model.start[path[0]] * model.emit[path[0], classes[0]]
        for a, b, x in zip(path, path[1:], classes[1:]):
            p *= model.move[a, b] * model.emit[b, x]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for a, x in zip(path, classes):
            emit[a, x] += p
    return np.concatenate([start, move.ravel(), emit.ravel()]) / total, math.log10(total)


@pytest.mark.parametrize("whole,segment,tokens", [(100, 64, 400_000), (2, 3, 400_000), (1, 2, 4), (1, 4, 400_000)])
def test_expected_counts_equal_all_paths_across_cuts(monkeypatch, whole, segment, tokens):
    for name, x in (("WHOLE", whole), ("SEGMENT", segment), ("TOKENS", tokens)):
        monkeypatch.setattr(hmm, name, x)
    m, sequences = small_model(), [[0, 1, 2, 1, 0, 2, 2, 1], [2], [1, 0, 0], [0, 0, 1, 2, 0, 1, 2]]
    got = m.learned(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    want = [path_counts(m, s) for s in sequences]
    assert np.allclose(got[:-1], sum(x for x, _ in want), atol=1e-4) and np.isclose(got[-1], sum(y for _, y in want), atol=1e-4)


def test_baum_welch_raises_the_likelihood():
    m, rng = small_model(3, 5), np.random.default_rng(4)
    classes, sizes = rng.integers(0, 4, 600), np.full(12, 50)
    before = m.forward(classes, sizes).sum()
    counts = m.expected(classes, sizes)
    assert np.isclose(counts[-15:].sum(), 600, atol=0.01) and np.isclose(counts[:3].sum(), 12, atol=0.01)
    for _ in range(3):
        m = m.improved(m.expected(classes, sizes))
        after = m.forward(classes, sizes).sum()
        assert after > before - 1e-6
        before = after


def brute(rows):
    docs = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    counts = collections.Counter(w for i, ws in docs if crc(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in docs)


@pytest.mark.parametrize("chunk", [20_000, 6 << 20])
def test_counts_and_base_scores(spark, sf, docs, odd, monkeypatch, chunk):
    monkeypatch.setattr(hmm, "CHUNK_BYTES", chunk)
    for df in (docs, odd):
        got = hmm.score(df).collect()
        n, want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_scores_beat_the_base_on_held_out_texts(spark, big):
    rows = [r for r in QUERIES["op4_hmm"](spark, big).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_all_rounds_see_all_training_texts_until_they_gain_little(spark, monkeypatch):
    """Words after character 2,000 decide the states: two kinds of text that begin alike."""
    rng = np.random.default_rng(5)
    tail = lambda i: " ".join(f"{'xy'[i % 2]}{rng.integers(40)}" for _ in range(300))
    df = spark.createDataFrame([(i, "same words here " * 130 + tail(i)) for i in range(60)], "doc_id long, text string")
    rounds, one = [], hmm.train_round
    monkeypatch.setattr(hmm, "train_round", lambda packed, model: rounds.append((packed, model, one(packed, model))) or rounds[-1][2])
    n = hmm.score(df).first()["train_tokens"]
    found = [likelihood / n for *_, (_, likelihood) in rounds]
    gains = np.diff(found)
    assert len(found) > 3 and (gains[:-1] >= hmm.GAIN).all() and gains[-1] < hmm.GAIN
    packed, _, (last, _) = rounds[-1]
    assert abs(one(packed, last)[1] / n - found[-1]) < hmm.GAIN


def test_hmm_of_nothing(none, odd):
    assert hmm.score(none).count() == 0
    untrained = hmm.score(odd, held=F.lit(True)).collect()
    assert len(untrained) == odd.count() and {r["n_known"] for r in untrained} == {0}
