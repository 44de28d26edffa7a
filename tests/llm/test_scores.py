"""Quality, toxicity, language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from strandloom.llm import folds, lm, quality, toxicity

RNG = random.Random(4)
PLAIN = ["".join(RNG.choice("etaoinshr") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def plain(n=60):
    return " ".join(RNG.choice(PLAIN) for _ in range(n))


def junk(n=60):
    return " ".join(RNG.choice(PLAIN).upper() + "!! ###" for _ in range(n))


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, junk() if bad else plain(), "en", "s"))
        marks.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in (0, 5, 123456)] + [(None,)], "d long").select("d", folds.fold(folds.F.col("d"), 7).alias("f"))
    assert [r.f for r in df.collect()] == [fold(0, 7), fold(5, 7), fold(123456, 7), 0]


def test_quality(corpus, odd_docs, no_docs):
    docs, labels = corpus
    model = quality.quality_model(docs, labels)
    rows = quality.scored(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    odd = quality.scored(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.score for r in odd if r.doc_id in (3, 4, 5)} == {model.base}
    assert quality.scored(no_docs, model).count() == 0
    empty = quality.quality_model(no_docs, labels)
    assert {r.score for r in quality.scored(odd_docs, empty).collect()} == {0.5}


def test_evidence_and_calibration_against_brute_force(spark, monkeypatch):
    """Compressed sizes made anew, the best logistic fit by a grid, and pieces from behind a long beginning."""
    monkeypatch.setattr(quality, "FIT_PIECES", 30)
    rows = [(i, (plain(1500) + " " if i % 3 == 0 else "") + (junk(400) if i % 2 else plain(400))) for i in range(160)] + [(7, "zz"), (7, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id long, quality int")
    model = quality.quality_model(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect() if r.doc_id != 7}
    tools = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False) for x in model.dictionaries]
    apart = []
    for i, text in rows[:160]:
        raw = text.encode()
        sizes = [sum(len(t.compress(raw[a : a + quality.PIECE])) for a in range(0, len(raw), quality.PIECE)) for t in tools]
        x = 10 * (sizes[0] - sizes[1]) / (len(raw) + 32)
        if i != 7:
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * x))), abs=1e-9)
            if fold(i, 4) != 2 and zlib.crc32(f"half:{i}".encode()) % 2:
                apart.append((x, 1 - i % 2))
    x, y = np.array(apart).T

    def loss(a, b):
        z = a + b * x
        return np.logaddexp(0, -z)[y == 1].sum() + np.logaddexp(0, z)[y == 0].sum() + 1e-3 * len(y) * b * b / 2

    best = loss(*model.weights)
    assert all(best <= loss(model.weights[0] + da, model.weights[1] + db) + 1e-9 for da in (-0.2, 0, 0.2) for db in (-0.2, 0, 0.2))


def test_labels_of_the_held_out_fold_do_not_count(corpus):
    docs, labels = corpus
    turned = labels.withColumn("quality", folds.F.when(folds.fold(folds.F.col("doc_id"), 4) == 2, 1 - folds.F.col("quality")).otherwise(folds.F.col("quality")))
    a, b = (sorted(map(tuple, quality.scored(docs, quality.quality_model(docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(200):
        bad = i % 2
        rows.append((i, " ".join(rng.choice(PLAIN) for _ in range(2500)) + (" zzgrumbel" * 200 if bad else "")))
        marks.append((i, bad))
    assert min(len(t) for _, t in rows) > 9000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.toxicity_model(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert len(model.lexicon.learned) and model.lexicon.features(pa.array([b"zzgrumbel"], pa.large_binary()))[0, 1] == 1
    held = [r for r in toxicity.scored(docs, model).collect() if r.held_out]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 5), (None, 1)], "doc_id long, toxic int")
    got = folds.labelled_sample(docs, labels, "toxic", (9, 100), 50).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a", 0), (2, None, 1)]


def test_toxicity_against_brute_force(spark):
    """Trees by following each row by itself, calibration as the best of all non-decreasing fits of the rows."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((200, 3)), 2)
    y = ((x[:, 0] > 0.4) & (rng.random(200) < 0.8)).astype(float)
    t = toxicity.Trees(n_trees=12).fit(x, y)
    for row, value in zip(x, t.raw(x), strict=True):
        z = t.start
        for tree, leaf in t.trees:
            node = 0
            for splits in tree:
                feature, cut = splits[node][0], splits[node][1]
                node = 2 * node + int(sum(c <= row[feature] for c in t.cuts[feature]) > cut)
            z += leaf[node]
        assert value == pytest.approx(z)
    z = t.raw(x)
    knots, values = toxicity.isotonic(z, y)
    order = np.argsort(z, kind="stable")
    s = y[order]
    # The isotonic fit at k is the least over j >= k of the largest mean over i <= k.
    want = [min(max(s[i : j + 1].mean() for i in range(k + 1)) for j in range(k, len(s))) for k in range(len(s))]
    got = np.interp(z[order], knots, values)
    assert np.corrcoef(got, want)[0, 1] > 0.99 and (np.diff(got) >= -1e-12).all()


def test_isotonic():
    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * z))).astype(float)
    knots, values = toxicity.isotonic(z, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 < values.min() < values.max() < 1
    assert abs(np.interp(z, knots, values).mean() - y.mean()) < 0.03


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = toxicity.Trees(n_trees=60).fit(x[:400], y[:400])
    assert ((t.raw(x[400:]) > 0) == y[400:]).mean() > 0.9


def test_toxic_features():
    lexicon = toxicity.Lexicon([], [])
    texts = ["you are an idiot", "an 1d10t here", "the IDIOT sat! Is it? far from all of them and more words then YOU", "", "plain words", None]
    f = lexicon.features(pa.array([t and t.encode() for t in texts], pa.binary()))
    get = lambda name: f[:, toxicity.NAMES.index(name)]
    assert get("insults")[0] == 1 / 4 and get("near_you")[0] > 0 and get("near_you")[2] == 0
    assert get("insults")[1] == 0 and get("disguised")[1] > 0
    assert get("shouted")[2] > 0 and get("marks")[2] > 0 and (f[3] == 0).all() and (f[5] == 0).all()


def test_toxicity(spark, odd_docs, no_docs):
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 1
        w = plain().split()
        if bad:
            w[7] = RNG.choice(["idiot", "moron,", "zorkish", "zorkable"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels)
    held = [r for r in toxicity.scored(docs, model).collect() if r.held_out]
    assert held and all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 1) for r in held) >= 0.95 * len(held)
    assert toxicity.scored(odd_docs, model).count() == odd_docs.count() and toxicity.scored(no_docs, model).count() == 0
    few = toxicity.toxicity_model(docs.limit(3), labels)
    assert len({r.score for r in toxicity.scored(odd_docs, few).collect()}) == 1


def base_scores(rows):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    split = [(d, (t or "").encode().translate(low).split() + [None]) for d, t in rows]
    n = Counter(x for d, w in split if fold(d, 7) != 2 for x in w)
    total, kinds = sum(n.values()), len(n)
    return [(d, fold(d, 7) == 2, len(w), sum(n[x] > 0 for x in w), total, sum(math.log10((n[x] + 1) / (total + kinds + 1)) for x in w)) for d, w in split]


def test_language_model(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(150):  # words follow each other by a rule that counts do not see
        w, k = [], rng.randrange(40)
        for _ in range(rng.randrange(5, 90)):
            k = (k * 3 + 1) % 40 if rng.random() < 0.9 else rng.randrange(40)
            w.append(f"w{k}" if rng.random() < 0.97 else f"Rare{rng.randrange(10**6)}")
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "w1 " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "RANGE_BYTES", 8000)
    monkeypatch.setattr(lm, "WORKER_TOKENS", 2000)
    got = {r.doc_id: r for r in lm.scored(df).collect()}
    for want in base_scores(rows):
        r = got[want[0]]
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5])
        assert r.score < 0
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = lm.scored(odd_docs).collect()
    want = base_scores([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(tuple(r)[:5] for r in odd) == sorted(w[:5] for w in want)
    assert lm.scored(no_docs).count() == 0


@pytest.mark.parametrize("tokens", [900_000, 3_000_000, 60_000_000])
def test_all_training_texts_reach_the_network(spark, monkeypatch, tokens):
    rows = [(i, i, i % 5 == 0, i % 5 != 0, f"w{i} w{i + 1} w0".encode()) for i in range(400)]
    docs = spark.createDataFrame(rows, "uid long, doc_id long, held_out boolean, trains boolean, body binary")
    v = lm.Vocabulary(np.array([lm._END], np.uint64), np.array([0], np.int32), np.array([400]), np.full(lm.TAILS, 3.0), tokens, 400)
    kept = {}

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    write = lm.staged
    monkeypatch.setattr(lm, "staged", keep)
    monkeypatch.setattr(lm, "WORKER_TOKENS", tokens // 3)
    seen = []
    monkeypatch.setattr(lm, "_average", lambda weights, average=lm._average: seen.append(weights) or average(weights))
    streams = lm._streams(docs, v)
    assert not np.array_equal(lm._trained(streams, v), lm.start(v))
    got = streams.collect()
    assert sorted(r.uid for r in got) == list(range(400)) and {r.uid for r in got if r.trains} == {r[0] for r in rows if r[3]}
    assert all(len(r.ids) == 4 * 2 for r in got)  # three words and the end token
    assert {r.worker for r in got} == {r.worker for r in kept["lm-weights"].collect()} == {0, 1, 2}


def test_model_is_a_distribution():
    v = lm.Vocabulary(np.array([3, 5, 9], np.uint64), np.array([0, 1, 2], np.int32), np.array([8, 4, 2]), np.full(lm.TAILS, 3.0), 14, 3)
    net = lm.unpack(lm.start(v))
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.HEAD + lm.TAILS)
    p, _ = lm.outputs(net, np.repeat(h, len(every), axis=0), every)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_gradient():
    rng = np.random.default_rng(2)
    v = lm.Vocabulary(np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.int32), np.full(50, 5), np.full(lm.TAILS, 2.0), 250, 50)
    net = lm.unpack(lm.start(v))
    h, ids = rng.normal(size=(6, lm.HIDDEN)).astype(np.float32), rng.integers(0, 50, 6)
    grad = lm.unpack(np.zeros(lm._SIZE, np.float32))
    _, back = lm.outputs(net, h, ids, grad)
    for i, j in ((0, 0), (3, 5), (5, 20)):
        up, down = h.copy(), h.copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        slope = -(lm.outputs(net, up, ids)[0].sum() - lm.outputs(net, down, ids)[0].sum()) / 2e-2
        assert back[i, j] == pytest.approx(slope, abs=2e-3)


def test_work_for_a_word(monkeypatch):
    """Head words are found without a search for each word; a gate of all lanes is one piece of memory."""
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 2**64, lm.HEAD, dtype=np.uint64))
    codes[1] = codes[0] + np.uint64(1)  # two that begin alike
    v = lm.Vocabulary(codes, rng.permutation(len(codes)).astype(np.int32), np.full(len(codes), 3), np.full(lm.TAILS, 9.0), 10**6, 4000)
    code = np.concatenate([rng.integers(0, 2**64, 200_000, dtype=np.uint64), rng.choice(codes, 200_000), codes - np.uint64(1), codes])
    tail = rng.integers(0, lm.TAILS, len(code)).astype(np.uint8)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, x, *more, **named: searched.append(np.size(x)) or search(a, x, *more, **named))
    got = v.ids(code, tail)
    assert sum(searched) < len(code) / 2
    number = dict(zip(codes.tolist(), v.number.tolist(), strict=True))
    assert got.tolist() == [number.get(c, lm.HEAD + t) for c, t in zip(code.tolist(), tail.tolist(), strict=True)]
    strides, step = set(), lm._step
    monkeypatch.setattr(lm, "_step", lambda net, x, h: strides.add(x.strides[0]) or step(net, x, h))
    flat = lm.train(lm.start(v), rng.integers(0, lm.HEAD, 3000), 0, lanes=8)
    lm.score(flat, rng.integers(0, lm.HEAD, 300), np.arange(0, 301, 30), 0, np.zeros(lm.TAILS), lanes=4)
    assert strides == {4}


def test_outputs_of_large_weights():
    """Beyond what single precision can exponentiate, against double precision."""
    rng = np.random.default_rng(5)
    net = {k: rng.standard_normal(shape).astype(np.float32) for k, shape in lm._SHAPES.items()}
    for k in ("class_w", "word_w"):
        net[k] *= 40
    h = np.tanh(rng.standard_normal((50, lm.HIDDEN))).astype(np.float32)
    ids = rng.integers(0, lm.HEAD + lm.TAILS, 50)
    got, _ = lm.outputs(net, h, ids)
    for g, row, y in zip(got, h.astype(float), ids, strict=True):
        kind = lm._classes(np.array([y]))[0]
        x = row @ net["class_w"] + net["class_b"]
        want = x[kind] - np.logaddexp.reduce(x)
        if y < lm.HEAD:
            members = np.arange(kind * lm._PER_CLASS, min(lm.HEAD, (kind + 1) * lm._PER_CLASS))
            x = net["word_w"][members] @ row + net["word_b"][members]
            want += x[y - members[0]] - np.logaddexp.reduce(x)
        assert g == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_gradient_through_time(monkeypatch):
    """One step of training moves each weight against the finite difference of the loss over a window."""
    rng = np.random.default_rng(3)
    v = lm.Vocabulary(np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.int32), np.full(50, 5), np.full(lm.TAILS, 2.0), 250, 50)
    flat = lm.start(v)
    flat += (rng.standard_normal(len(flat)) * 0.1).astype(np.float32)
    stream = rng.integers(0, 50, 24)

    def loss(f):
        net, h, out = lm.unpack(f.astype(np.float32)), np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for x, y in zip([0, *stream[:-1]], stream, strict=True):
            h, _ = lm._step(net, net["table"][[x]] @ net["inward"] + net["inward_b"], h * np.float32(x != 0))
            out -= lm.outputs(net, h, np.array([y]))[0][0]
        return out

    moved = lm.train(flat, stream, 0, lanes=1, steps=24, rate=1e-3) - flat
    # Adagrad's first step: rate * g / sqrt(0.001 + g * g) with g = gradient / (24 / 32), clipped.
    places = {"table": 9, "inward": 5, "inward_b": 5, "loop": 9}
    at = 0
    for name, shape in lm._SHAPES.items():
        n = math.prod(shape)
        if name in places:
            for i in at + np.argsort(-np.abs(moved[at : at + n]))[: places[name]]:
                up, down = flat.astype(np.float64).copy(), flat.astype(np.float64).copy()
                up[i] += 1e-2
                down[i] -= 1e-2
                g = (loss(up) - loss(down)) / 2e-2 / (24 / 32)
                assert moved[i] == pytest.approx(-1e-3 * g / math.sqrt(1e-3 + g * g), rel=0.1, abs=5e-5), (name, i)
        at += n


def test_score_against_plain_loops():
    """Word by word in double precision: gates, state, class and word probabilities."""
    rng = np.random.default_rng(6)
    v = lm.Vocabulary(np.arange(lm.HEAD, dtype=np.uint64), np.arange(lm.HEAD, dtype=np.int32), np.arange(lm.HEAD, 0, -1), np.full(lm.TAILS, 9.0), 10**6, 4000)
    flat = lm.start(v) + (rng.standard_normal(lm._SIZE) * 0.05).astype(np.float32)
    net = {k: x.astype(float) for k, x in lm.unpack(flat).items()}
    tail_log = rng.random(lm.TAILS)
    size = np.array([1, 40, 7, 0, 90])
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, lm.HEAD + lm.TAILS, bounds[-1])
    sigmoid, k, per = lambda x: 1 / (1 + np.exp(-x)), lm.HIDDEN, lm._PER_CLASS
    want = []
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        h, last, total = np.zeros(k), 0, 0.0
        for y in ids[a:z]:
            x, u = net["table"][last] @ net["inward"] + net["inward_b"], h @ net["loop"]
            update, reset = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
            h = (1 - update) * np.tanh(x[2 * k :] + reset * u[2 * k :]) + update * h
            kind = y // per if y < lm.HEAD else y - lm.HEAD + lm.CLASSES
            p = np.exp(h @ net["class_w"] + net["class_b"])
            total += math.log10(p[kind] / p.sum())
            if y < lm.HEAD:
                members = range(kind * per, min(lm.HEAD, (kind + 1) * per))
                q = [math.exp(net["word_w"][i] @ h + net["word_b"][i]) for i in members]
                total += math.log10(q[y - members[0]] / sum(q))
            else:
                total -= tail_log[y - lm.HEAD]
            last = y
        want.append(total)
    assert lm.score(flat, ids, bounds, 0, tail_log, lanes=3, steps=8) == pytest.approx(want, rel=1e-4, abs=1e-9)


def test_state_is_carried_over_windows():
    v = lm.Vocabulary(np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.int32), np.full(50, 5), np.full(lm.TAILS, 2.0), 250, 50)
    flat = lm.start(v)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 400).astype(np.int32)
    bounds = np.array([0, 150, 151, 400])
    one = lm.score(flat, ids, bounds, 0, np.zeros(lm.TAILS), lanes=2, steps=7)
    two = lm.score(flat, ids, bounds, 0, np.zeros(lm.TAILS), lanes=512, steps=1000)
    each = [lm.score(flat, ids[a:z], np.array([0, z - a]), 0, np.zeros(lm.TAILS))[0] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    assert one == pytest.approx(each, rel=1e-5)
    assert one == pytest.approx(two, rel=1e-5)
