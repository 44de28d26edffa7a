import pyarrow as pa

from strandloom.operators import encoders


def test_slices_are_bounded_and_whole():
    seqs = [b"A" * n for n in (0, 3, 70, 5, 5, 5, 200, 1, 0)] * 40 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs, pa.binary())], names=["seq_id", "seq"]).slice(2)
    rows, letters = encoders.SLICE_ROWS, encoders.SLICE_LETTERS
    try:
        encoders.SLICE_ROWS, encoders.SLICE_LETTERS = 4, 100
        parts = list(encoders.slices(iter([batch, batch.slice(0, 0)])))
    finally:
        encoders.SLICE_ROWS, encoders.SLICE_LETTERS = rows, letters
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(x or b"") for x in p.column(1).to_pylist()) <= 100) for p in parts)


def test_mismatch_result_comes_in_bounded_parts(spark, monkeypatch):
    """What a worker holds does not follow the size of its Arrow batch."""
    sizes = []

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([b"ACGTTGCAAC" * 8] * 3000, pa.binary())], names=["seq_id", "seq"])
            sizes.extend(len(x) for x in run(iter([batch])))

    encoders.MismatchEncoder(4, 2).transform(Rows())
    assert len(sizes) > 1 and max(sizes) <= encoders.SLICE_ROWS * 4**4
