import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import text as tx


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    column = pa.array([t.encode("utf-8", "ignore") for t in texts], pa.binary())
    for table, pattern, lower in ((tx.byte_table(), r"[^\x20\x09-\x0D]+", False), (tx.byte_table(lower=True), r"[^\x20\x09-\x0D]+", True), (tx.byte_table(lower=True, alnum=True), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        got, codes = [], {}
        for w in tx.tokenise(column, table):
            raw = w.data.tobytes()
            for i in range(len(w.first) - 1):
                words = [raw[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
                got.append(words)
                for x, h in zip(words, w.hash[w.first[i] : w.first[i + 1]], strict=True):
                    assert codes.setdefault(x, h) == h
        fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t
        want = [re.findall(pattern, fold(t.encode("utf-8", "ignore").decode())) for t in texts]
        assert [[x.decode() for x in d] for d in got] == want
        assert len(set(codes.values())) == len(codes)


def test_nulls_and_slices():
    column = pa.array([b"a b", None, b"", b"c"], pa.binary()).slice(1)
    parts = list(tx.tokenise(column, tx.byte_table()))
    assert sum(len(p.hash) for p in parts) == 1 and sum(len(p.first) - 1 for p in parts) == 3
    assert len(tx.windows(np.zeros(2, np.uint64), 3)) == 0
