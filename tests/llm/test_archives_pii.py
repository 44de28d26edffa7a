"""ARC and WARC, surrogates, the pipeline and the registered queries."""

import gzip
import hashlib
import ipaddress
import io
import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from strandloom.llm import pii, warc


def test_arc_versions_and_declared_lengths():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline\nhttp://x 1.2.3.4 20010101000000 text/html 5\nhello"
        raw = warc.arc_version_block("x.arc", version, "20010203040506") + b"\n" + warc.arc_record(version, "http://a/", "1.2.3.4", "20010203040506", "text/html", body, "x.arc") + b"\n" + warc.arc_record(version, "http://b/", "1.2.3.4", "20010203", "text/plain", b"", "x.arc") + b"\n"
        records = list(warc.read_arc(io.BytesIO(raw)))
        assert [r.fields["URL"] for r in records] == ["http://a/", "http://b/"] and records[0].body == body and records[1].body == b""
        cut = list(warc.read_arc(io.BytesIO(raw[: raw.index(b"line")])))
        assert len(cut) == 1 and isinstance(cut[0], warc.Broken) and "declared" in cut[0].reason
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"http://a/ 1 2 3 4\n")))
    assert warc.iso("20010203040506") == "2001-02-03T04:05:06Z" and warc.iso("20010203") == "2001-02-03T00:00:00Z"


def test_unusual_and_broken_records(spark, tmp_path):
    """Blanks and odd bytes in URLs are read; broken records are left out and listed, those behind them are read."""
    date, page = "20010203040506", lambda n: b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % n + b"p" * 120
    one = lambda head, body: head + b" %d\n" % len(body) + body + b"\n"
    rest = b" 1.2.3.4 " + date.encode() + b" text/html"
    raw = warc.arc_version_block("x.arc", 1, date) + b"\n"
    raw += one(b"http://a/with blank" + rest, page(1)) + one(b"http://b/\xff\xe9" + rest, page(2)) + one(b"http://c/ 1.2.3.4 yesterday text/html", page(3))
    raw += b"garbage in between\n" + one(b"short", b"http") + one(b"http://d/" + rest, page(4)) + b"http://e/" + rest + b" many\nlost\n" + one(b"http://f/" + rest, page(5))
    raw += one(b"http://g/" + rest, b"HTTP/1.1 200 OK\r\nX-Page-Id: none\r\n\r\nno number") + b"http://h/" + rest + b" 500\ncut off"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "x.arc").write_bytes(raw)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r.url: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert set(got) == {"http://a/with%20blank", "http://b/%FF%E9", "http://d/", "http://f/", "http://g/"}
    assert got["http://d/"].record_type == "revisit" and got["http://d/"].refers_to == 1 and got["http://d/"].payload_bytes == 120
    assert got["http://g/"].page_id is None and len({r.record_id for r in got.values()}) == 5
    left = [(r.reason, raw[r.offset :].startswith(bytes(r.header))) for r in warc.quarantined(spark, str(tmp_path / "arc")).collect()]
    assert [x for x, _ in left] == ["no date", "no length", "500 bytes declared, 7 there"]
    assert all(ok for _, ok in left)


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    df = spark.createDataFrame([(i, "u", "x" * (20_000 if i == 7 else 900)) for i in range(40)], "page_id long, url string, html string").repartition(1)
    warc.write_arc(df.withColumn("value", df.url).withColumn("content", df.url), str(tmp_path / "arc"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "arc").glob("part-*")]
    assert len(sizes) >= 8 and sorted(sizes)[-2] < 6000 < 20_000 < max(sizes) < 27_000
    assert warc.quarantined(spark, str(tmp_path / "arc")).count() == 0


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    long, tricky = "x" * 100, "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n" * 5
    rows = [(5, "http://a/ b", long), (2, None, long), (9, "u", long), (1, "u", "x" * 99), (3, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", tricky), (8, "u", "é" * 60), (10, "u", "é" * 60), (2, "dup", long), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()], key=repr)
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        refers = first.get(h) if p is not None and p != first.get(h) else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_permutation_is_one_cycle_without_fixed_points():
    for low, high in ((1, 2), (7, 9), (1, 30), (16, 16)):
        out = [pii.permuted(b"k", b"t", i, low, high) for i in range(low * high)]
        assert sorted(out) == list(range(low * high)) and all(a != b for a, b in enumerate(out))


SAMPLES = {
    "email": ["chein.36@mail5.example.com", "Jo_Ann+x@Sub.Domain.co.uk"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0123", "+44 20 7946 0958"],
    "ip": ["148.9.179.169", "10.0.0.7", "192.168.1.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
    "card": ["4303624562121775", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
}


KEY = b"a key for tests"


@pytest.mark.parametrize("kind", list(SAMPLES))
def test_formats(kind):
    for x in SAMPLES[kind]:
        text, found = pii.replaced(f"see {x} here", KEY)
        assert [(k, o) for k, o, _ in found] == [(kind, x)]
        new = found[0][2]
        assert text == f"see {new} here" and new != x
        if kind != "ip":
            assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", new))) == re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", x)))
        if kind == "card":
            luhn = lambda s: pii._luhn(re.sub(r"\D", "", s)[:-1]) == int(s[-1])
            assert luhn(new) == luhn(x)
        if kind == "iban":
            p, q = new.replace(" ", ""), x.replace(" ", "")
            right = lambda p: int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
            assert right(p) == right(q)
    assert pii.surrogate("ip", "10.0.0.7", KEY).startswith("10.") and pii.surrogate("ip", "192.168.1.1", KEY).startswith("192.168.")
    assert pii.surrogate("email", "a1@mail.example.com", KEY).endswith(".example.com")


def test_coreference_names_and_secrets():
    text, found = pii.replaced('Mrs. Anna Jones met Dr. Łukasz Müller. Anna called. token = "CF1D64A9" then token = "cf1d64a9a4cd9723"; JO@X.ORG or jo@x.org', KEY)
    new = {o: s for _, o, s in found}
    assert text.count(new["Anna"]) == 2 and new["Anna"][-1] == "a" and new["Anna"][0].isupper() and "Anna" not in text and "Müller" not in text
    assert new["Łukasz"] != "Łukasz" and new["Łukasz"][0].isupper()
    assert new["JO@X.ORG"] == new["jo@x.org"].upper()
    assert re.fullmatch(r"[0-9a-f]{16}", new["cf1d64a9a4cd9723"])
    for plain in ("plain 12 words, 3.14159 and 2021-10-10 stay", "order 1234567890123456 std::vector secret: garden at 12:30:45", "٣٤٥-٣٤٥-٣٤٥٦"):
        assert pii.replaced(plain, KEY) == (plain, [])


def test_one_entity_in_many_shapes():
    def of(text):
        (_, _, new), *rest = pii.replaced(f"see {text} here", KEY)[1]
        assert not rest
        return new

    numbers = ["+1-2125550123", "+12125550123", "+1 (212) 555-0123", "+1.212.555.0123"]
    assert {re.sub(r"\D", "", of(x)) for x in numbers} == {re.sub(r"\D", "", of(numbers[0]))} and of(numbers[0]).startswith("+1-")
    assert of("4111 1111 1111 1111").replace(" ", "") == of("4111111111111111") == of("4111-1111-1111-1111").replace("-", "")
    assert of("GB82 WEST 1234 5698 7654 32").replace(" ", "") == of("GB82WEST12345698765432")
    six = [ipaddress.ip_address(of(x)) for x in ("2001::8a2e:370:7334", "2001:0000:0000:0000:0000:8a2e:0370:7334", "2001:0:0:0:0:8A2E:370:7334")]
    assert len(set(six)) == 1 and six[0].exploded.startswith("2001:")
    assert pii.replaced("password: hunter2 and token=correct-horse!battery", KEY)[0].split()[1] != "hunter2"
    assert "battery" not in pii.replaced("token=correct-horse!battery", KEY)[0]
    assert pii.replaced("李雷测试@例子测试.中国", KEY)[0] != "李雷测试@例子测试.中国"


def test_surrogates_are_one_to_one():
    """Against a table: small classes of entities, all of them, and texts that a table of originals restores."""
    every = {
        "hex": [("secret", f"{i:03x}") for i in range(4096)],
        "other": [("secret", a + b + c) for a in "afgz" for b in "09x" for c in "bcdefghij"],
        "phone": [("phone", f"+1{i:03d}") for i in range(1000)] + [("phone", f"+49{i:02d}") for i in range(100)] + [("phone", f"{i:03d}") for i in range(1000)],
        "iban": [("iban", f"DE{c:02d}{b}") for c in range(100) for b in ("1A2", "1B2", "3A4", "9Z9")],
        "card": [("card", f"{i:04d}") for i in range(10000)],
        "name": [("name", a + b) for a in "ABEIŁŠЖ" for b in ("nna", "nno", "lle", "łłł", "жжж")],
    }
    for entities in every.values():
        table = {}
        for kind, x in entities:
            new = pii.surrogate(kind, x, KEY)
            assert new != x and table.setdefault(pii.canonical(kind, new), pii.canonical(kind, x)) == pii.canonical(kind, x)


def test_surrogates_on_rows(spark, odd_docs, no_docs, monkeypatch):
    out = pii.surrogates(odd_docs)
    assert out.columns == [*odd_docs.columns, "_entities"]
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == sorted((r.doc_id, r.text) for r in odd_docs.collect() if r.text)
    assert pii.surrogates(no_docs).count() == 0
    taken = odd_docs.withColumn("_entities", odd_docs.text).withColumn("__Entities", odd_docs.text)
    assert pii.checked(taken).columns == [*taken.columns, "___entities"]
    many = spark.createDataFrame([(i, f"10.1.{i // 250}.{i % 250} and u{i}@m.example.com, again U{i}@M.example.com") for i in range(600)], "doc_id long, text string")
    made = pii.checked(many)
    assert pii.collisions(made).count() == 0
    assert made.selectExpr("inline(_entities)").select("kind", "surrogate").distinct().count() == 1200
    assert pii.counted(made).where("n_email = 2 AND n_ip = 1 AND n_entities = 3").count() == 600
    kind = "doc_id long, _entities array<struct<kind:string,original:string,surrogate:string>>"
    assert pii.collisions(spark.createDataFrame([(1, [("ip", "a", "x")]), (2, [("ip", "b", "x")])], kind)).count() == 1
    assert pii.collisions(spark.createDataFrame([(1, [("ip", "a", "x")]), (2, [("ip", "a", "y")])], kind)).count() == 1
    # A forced clash: the first key gives collisions, the derived one does not.
    make, keys = pii.surrogates, []

    def clashing(docs, text, key):
        keys.append(key)
        return make(docs, text, key) if len(keys) > 1 else make(docs, text, key).selectExpr("doc_id", "text", "transform(_entities, e -> named_struct('kind', e.kind, 'original', e.original, 'surrogate', 'x')) AS _entities")

    monkeypatch.setattr(pii, "surrogates", clashing)
    again = pii.checked(many, key=KEY)
    assert len(set(keys)) == 2 and pii.collisions(again).count() == 0


def test_key(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32
    df = spark.createDataFrame([(1, "a1@mail.example.com")], "doc_id long, text string")
    one = pii.surrogates(df).first().text
    spark.conf.set(pii.SETTING, "another")
    try:
        assert pii.session_key(spark) == b"another" and pii.surrogates(df).first().text != one
    finally:
        spark.conf.unset(pii.SETTING)


def test_pipeline(spark, tmp_path, odd_docs):
    words = [f"word{i}" for i in range(400)]
    rng = random.Random(6)
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    bench = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0", 1), (101, clean[1] + " tail", "en", "s1", 1), (102, clean[2] + " " + bench, "en", "s0", 1), (103, "too short", "en", "s0", 1), (104, None, "en", "s0", None), (105, " ".join(reversed(words[:90])) + " write to a.b@mail.example.com", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = out.collect()
    assert {r.doc_id for r in got} <= set(range(40)) | {105}
    texts = {r.doc_id: r.text for r in got}
    assert all(texts[i] == clean[i] for i in texts if i < 40)
    assert all("a.b@mail" not in t for t in texts.values())
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), ""), "").collect()}
    assert kept == set(range(40)) | {102, 105}
    for _, stage in corpus_pipeline.STAGES:
        (tmp_path / "odd").mkdir(exist_ok=True)
        assert stage(spark, odd_docs, str(tmp_path)).columns == odd_docs.columns
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii_surrogates", "source_mixing"]
