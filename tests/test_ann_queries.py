import numpy as np
import pytest

from strandloom.operators.distance import NeedlemanWunsch, SmithWaterman, _align
from strandloom.plans import catalogue


@pytest.mark.parametrize("name, local", [("ann_topk_nw", False), ("ann_topk_sw", True)])
def test_alignment_searches_look_at_all_documents(spark, tmp_path, name, local):
    rng = np.random.default_rng(3)
    seqs = {i: "".join(rng.choice(list("acgt"), int(rng.integers(1, 30)))) for i in range(90, 115)}
    spark.createDataFrame(list(seqs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "acgt") for i in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = (SmithWaterman if local else NeedlemanWunsch)().table
    q = seqs[100].upper().encode()

    def distance(s):
        r = s.upper().encode()
        return max(len(q), len(r)) - _align(q, r, table, -1, local)

    got = sorted((r["rank"], r.r_id, r.d) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
    want = sorted((distance(s), i) for i, s in seqs.items())[:10]
    assert got == [(n, i, d) for n, (d, i) in enumerate(want, 1)]


def test_pruned_search_is_exact_and_looks_at_few(spark):
    """Recall 1 against all distances, ties by id; few pairs are compared where lengths and letters differ."""
    import random

    from strandloom.operators.ann import ANNIndex
    from strandloom.operators.distance import Levenshtein

    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ACGT", [rng.random() + 0.05 for _ in range(4)], k=rng.randrange(0, 90)))) for i in range(300)]
    rows += [(400 + i, rows[i][1] + "ACG"[: i % 4]) for i in range(40)] + [(500, "NNNN"), (501, "")]
    refs = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    queries = refs.where("seq_id % 20 = 0")
    every = Levenshtein().cdist(queries, refs).collect()
    want = {q: [(r, d) for d, r in sorted((x.d, x.b_id) for x in every if x.a_id == q)[:5]] for q in {x.a_id for x in every}}
    index, got = ANNIndex(refs), {}
    for r in sorted(index.query(queries, k=5).collect(), key=lambda r: (r.q_id, r["rank"])):
        got.setdefault(r.q_id, []).append((r.r_id, r.d))
    assert got == want
    assert index._pruned(queries, 5).count() < 0.4 * len(every)
    few = ANNIndex(refs.limit(3)).query(queries.limit(1), k=5).collect()
    assert len(few) == 3
