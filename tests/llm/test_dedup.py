"""Near duplicates and repeated passages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import graph, minhash, substrings
from strandloom.llm import text as tx

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 7))) for _ in range(800)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, 200), rng.integers(20, 80, 260)
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    got = [np.mean(minhash.signature(tx.mix(a.astype(np.uint64) + np.uint64(s << 20))) == minhash.signature(tx.mix(b.astype(np.uint64) + np.uint64(s << 20)))) for s in range(80)]
    assert np.mean(got) == pytest.approx(want, abs=0.015)


def brute_classes(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(d, minhash.multiset((t or "").encode())) for d, t in rows]
    for i, (d, a) in enumerate(bags):
        for e, b in bags[:i]:
            if a and b and minhash.similarity(a, b) >= 0.8:
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_classes_against_brute_force(spark):
    base = prose(150)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, "  ".join(base)), (3, None), (4, ""), (5, " \n"), (6, "two words"), (7, "two words"), (8, "two  words")]
    for i in range(9, 70):  # a group of near copies, from nearly equal to rather different
        w = list(base)
        for _ in range(RNG.randrange(0, 9)):
            w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(prose(60))) for i in range(70, 100)]
    rows += [(100, "a b c d e " * 30), (101, "a b c d e " * 29), (102, "a b c d e " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == brute_classes(rows)
    kept = {r.doc_id for r in minhash.deduplicated(df).collect()}
    assert kept == set(brute_classes(rows).values())


def test_overlaps_and_forest():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 30, rng.integers(1, 60)) for _ in range(40)] + [rng.integers(0, 3000, rng.integers(1, 500)) for _ in range(60)]
    codes = [minhash.occurrences(x.astype(np.uint64)) for x in rows]
    left, right = np.arange(70), np.arange(40, 100)
    got = minhash.overlaps(codes, left, right)
    for k, i in enumerate(left):
        for n, j in enumerate(right):
            if i != j:
                assert got[k, n] == sum((Counter(rows[i].tolist()) & Counter(rows[j].tolist())).values())
    linked, label = rng.random((70, 60)) < 0.05, rng.integers(0, 50, 100)
    pairs = minhash.forest(linked, left, right, label)

    def joined(edges):
        root = {x: x for x in label.tolist()}
        for i, j in edges:
            a, b = root[label[i]], root[label[j]]
            root = {k: a if v == b else v for k, v in root.items()}
        return root

    every = joined(pairs)
    want = joined([(left[i], right[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    assert len({(every[a], want[a]) for a in every}) == len(set(every.values())) == len(set(want.values()))
    assert len(pairs) < 50 and all(linked[i, j - 40] for i, j in pairs)


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_that_no_leader_joins(spark, monkeypatch, block):
    """Copies of which many are 0.7 alike and few 0.8: classes as by brute force, links fewer than texts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, made = random.Random(8), []
    base = prose(120)
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(2, 5)):
            w[rng.randrange(24) * 5] = rng.choice(VOCABULARY)
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    seen, check = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: seen.append(pairs.count()) or check(pairs, *a))
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == brute_classes(made) and 1 < len(set(got.values())) < 90
    if block == 1024:
        assert seen[-1] < 90


def test_different_texts_under_one_id(spark):
    one, two = " ".join(prose(50)), " ".join(prose(60))
    rows = [(5, one), (5, two), (5, two), (7, two + " end"), (8, one), (9, " ".join(prose(40))), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in minhash.classes(df).collect())
    assert got == Counter({(5, 5): 3, (7, 5): 1, (8, 5): 1, (9, 9): 3})
    kept = Counter((r.doc_id, r.text) for r in minhash.deduplicated(df).collect())
    assert kept[(9, None)] == 2 and kept[(9, rows[5][1])] == 1 and sum(kept.values()) == 5
    assert kept[(5, one)] == kept[(5, two)] == 1


def test_odd_rows(spark, odd_docs, no_docs):
    got = minhash.classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    kept = minhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.classes(no_docs).count() == 0 and minhash.deduplicated(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.class_id is None) for r in minhash.classes(nulls).collect()) == [False, True, True]
    assert minhash.deduplicated(nulls).count() == 3


def test_components_by_joins_and_in_one_task(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500), (7, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.id: r.label for r in graph.components(df).collect()}
    two = {r.id: r.label for r in graph.components(df, local=False).collect()}
    assert one == two and one[900] == 0 and one[60] == 0


def brute_removed(rows):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    n = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages():
    shared, other = prose(60), prose(36)
    rows = [(i, " ".join(prose(RNG.randrange(0, 80)) + shared[RNG.randrange(5) : 60 - RNG.randrange(5)] + prose(RNG.randrange(0, 50)))) for i in range(30)]
    whole = " ".join(prose(90))
    rows += [(40, whole), (41, whole), (42, " ".join(other * 3)), (43, " ".join(["x"] * 80)), (44, " ".join(["x"] * 35)), (45, " ".join(["y"] * 35)), (46, None), (47, ""), (48, " ".join(other[:34]))]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_passages_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, substrings.digest(substrings.removed(df)).collect()), key=repr)
    assert got == brute_removed(rows)


def test_passages_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, substrings.digest(substrings.removed(odd_docs)).collect()), key=repr)
    assert got == brute_removed(rows)
    assert substrings.removed(no_docs).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 6, 400)
    first = np.array([0, 100, 250, 400])
    index = substrings.FMIndex(words, first, np.array([1, 2, 1]), 6)
    text = [words[a:z].tolist() for a, z in zip(first[:-1], first[1:], strict=True)]
    for n in (1, 2, 3, 4):
        for _ in range(20):
            pattern = rng.integers(1, 6, n)
            low, high = np.array([0]), np.array([len(index.weights) - 1])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            want = sum(w * sum(t[i : i + n] == pattern.tolist() for i in range(len(t) - n + 1)) for t, w in zip(text, (1, 2, 1), strict=True))
            assert index.occurrences(low, high)[0] == want
