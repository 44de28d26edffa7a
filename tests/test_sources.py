from strandloom.operators.encoders import SpectrumEncoder
from strandloom.sources.fasta import read_fasta, write_fasta
from strandloom.streaming.encode import encode_stream


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\r\nGG\r\n>three\n\n>four x\nT")
    rows = {r.name: r.seq for r in read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": "ACGTAC", "two": "GG", "three": "", "four": "T"}
    write_fasta(read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert {r.name: r.seq for r in read_fasta(spark, str(tmp_path / "out")).collect()} == rows


def test_encoder_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ACGT"), (2, "AAA")], "seq_id long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    encode_stream(stream, SpectrumEncoder(2), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    got = {(r.seq_id, r.feature): r.cnt for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "AC"): 1, (1, "CG"): 1, (1, "GT"): 1, (2, "AA"): 2}
