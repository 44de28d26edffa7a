import random

import numpy as np

from strandloom.operators.ann import ANNIndex
from strandloom.operators.gkm import Largest


def test_largest_keeps_ties_and_what_rounds_to_them():
    largest = Largest(2, 1)
    assert list(largest.add(np.array([[0.5], [0.9], [0.1], [0.5], [0.499999]]))[0]) == [0, 1, 3, 4]
    assert list(largest.add(np.array([[0.4], [0.6]]))[0]) == [1]
    assert len(Largest(3, 2).add(np.zeros((0, 2)))[0]) == 0


def test_gkm_search_keeps_the_nearest_in_each_task(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACGT", k=rng.randrange(6, 40)))) for i in range(120)]
    rows += [(i + 500, s) for i, s in rows[:20]]
    df = spark.createDataFrame(rows, "seq_id long, seq string").repartition(2)
    queries = df.where("seq_id % 40 = 0")
    index = ANNIndex(df, "gkm", gkm_L=6, gkm_k=4, gkm_d=2, gkm_use_rc=True)
    every = index.distances(queries)
    few = index.distances(queries, 4)
    assert few.count() < every.count()
    want = ANNIndex._ranked(every, 4).collect()
    got = index.query(queries, 4).collect()
    assert sorted((r.q_id, r["rank"], r.r_id, round(r.d, 9)) for r in got) == sorted((r.q_id, r["rank"], r.r_id, round(r.d, 9)) for r in want)
