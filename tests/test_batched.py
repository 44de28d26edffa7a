import random

import numpy as np
import pytest

from strandloom.operators.batched import Block, Measure, Nearest, blocks, letter_counts
from strandloom.operators.distance import NeedlemanWunsch, _align


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def sample(n, longest):
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGT", [rng.random() + 0.05 for _ in range(4)], k=rng.randrange(longest))) for _ in range(n)]
    return [*seqs, "", "", "A", "NNNN", "ACGNÄ", "AC" * 20, seqs[0]]


def plain(kind, a, b):
    table = NeedlemanWunsch().table
    return edit(a, b) if kind == "edit" else max(len(a), len(b)) - _align(a.encode("latin1"), b.encode("latin1"), table, -1, kind == "local")


@pytest.mark.parametrize("kind", ["edit", "global", "local"])
def test_blocks_against_plain_tables(kind):
    seqs, measure = sample(60, 70), Measure(kind)
    measure.cells = 700
    parts, texts = blocks(seqs, measure.cells), sample(60, 70)[-12:]
    assert sorted(i for b in parts for i in b.rows) == list(range(len(seqs)))
    for b in parts:
        got, lower = measure.of(b, texts), measure.bound(b, letter_counts(texts))
        want = np.array([[plain(kind, s, t) for s in b.seqs] for t in texts])
        assert (got == want).all() and (lower <= want).all()


@pytest.mark.parametrize("kind", ["edit", "global", "local"])
def test_nearest_in_batches_and_few_comparisons(kind, monkeypatch):
    seqs = sample(150, 60)
    queries, found, made = seqs[::15], {}, [0]
    measure = Measure(kind)
    of = measure.of
    measure.of = lambda b, texts: (made.__setitem__(0, made[0] + len(texts) * len(b.seqs)), of(b, texts))[1]
    near = Nearest(measure, queries, 4)
    for low in range(0, len(seqs), 40):
        for q, r, d in zip(*near.add(np.arange(low, min(low + 40, len(seqs))), seqs[low : low + 40]), strict=True):
            found.setdefault(int(q), []).append((d, low + int(r)))
    for i, q in enumerate(queries):
        assert sorted(found[i])[:4] == sorted((plain(kind, q, s), j) for j, s in enumerate(seqs))[:4]
    assert made[0] < len(queries) * len(seqs)
    assert Block([0], [""]).edit("ACG").tolist() == [3]


def test_search_by_scores_is_not_bounded_by_distances(spark):
    df = spark.createDataFrame([(i, "ACGT" * i) for i in range(5)], "seq_id long, seq string")
    assert NeedlemanWunsch().nearest(df, df, 2) is None and NeedlemanWunsch(gap=-2, as_distance=True).nearest(df, df, 2) is None
    rows = NeedlemanWunsch(as_distance=True).cdist(df, spark.createDataFrame([(7, None), (8, "ACG")], "seq_id long, seq string")).collect()
    assert {(r.a_id, r.b_id): r.d for r in rows if r.a_id < 2} == {(0, 7): None, (0, 8): 6.0, (1, 7): None, (1, 8): 2.0}
