"""The whole pipeline against a plain one."""

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from strandloom.llm import minhash, pii
from strandloom.llm.queries import SQL

KEY = "a key for tests"


def rows_of(spark, documents, sql):
    """``sql`` of DuckDB over the rows, as dictionaries."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", documents)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def plain_classes(rows):
    bags, label = [(d, minhash.multiset((t or "").encode())) for d, t in rows], {d: d for d, _ in rows}
    for i, (d, a) in enumerate(bags):
        for e, b in bags[:i]:
            if a and b and minhash.similarity(a, b) >= 0.8 and label[d] != label[e]:
                x, y = sorted((label[d], label[e]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hit_by(text, items):
    """(words in windows of items, whether a window of 13 words is among them)."""
    w, hit, full = words(text), set(), False
    for item in items:
        v = words(item)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                full |= n == 13
    return len(hit), full


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [" ".join(prose(n)) for n in (30, 20, 13, 5)]
    rows = []
    for i in range(90):
        w = prose(rng.randrange(20, 120))
        if i % 9 == 1:
            w[3:3] = items[i % 3].split()[: rng.choice((12, 13, 30))]
        if i % 9 == 2:
            w[5:5] = [f"mail {w[0]}.{i}@mail{i % 4}.example.com or +1 (212) 555-{1000 + i}, card 4111111111111111"]
        if i % 9 == 4:
            w = (["###"] * 9 + w[:4]) * 3
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    for i in range(90, 130):  # copies, from equal to rather different
        w = rows[rng.choice((0, 3, 5, 6))][1].split(" ")
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    rows += [(200, " ".join(prose(1500) + items[2].split() + prose(500)), "en", "s0", 0), (201, None, "fr", None, None), (202, "", None, "s1", 0), (203, "tiny", "en", "s1", 4), (204, " ".join([*prose(300), *items[3].split()]), "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.set(pii.SETTING, KEY)
    yield rows, items, str(tmp_path)
    spark.conf.unset(pii.SETTING)


def test_pipeline_against_a_plain_one(spark, corpus):
    rows, items, folder = corpus
    kept = {r["doc_id"] for r in rows_of(spark, rows, SQL["op6_quality_rules"]) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    label = plain_classes([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if label[r[0]] == r[0]]
    assert 20 < len(rows) < len(label)
    clean = []
    for r in rows:
        n, full = hit_by(r[1], items)
        if not full and not (n and 20 * n >= len(words(r[1]))):
            clean.append(r)
    assert {200} <= {r[0] for r in rows} - {r[0] for r in clean} and 204 in {r[0] for r in clean}
    safe = [(d, t and pii.replaced(t, KEY.encode())[0], lang, source, n if t is None else len(pii.replaced(t, KEY.encode())[0])) for d, t, lang, source, n in clean]
    assert sum(a != b for (_, a, *_), (_, b, *_) in zip(clean, safe, strict=True)) >= 5
    copies = {r["doc_id"]: r["copies"] for r in rows_of(spark, safe, SQL["op8_source_mixing"])}
    want = Counter({r: copies[r[0]] for r in safe if copies[r[0]]})
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want
