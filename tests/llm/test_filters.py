"""Quality rules, mixing, decontamination."""

import hashlib
import random
import re
from collections import Counter

import pytest

from strandloom.llm import decontam, mixing, rules, scratch


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules_base_counts(odd_docs):
    rows = rules.quality_rules(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    for r in rows:
        t = texts[r.doc_id] or ""
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_rules_overlapping_repeats(spark):
    t = "a b c d e f a b c d e f a b c d e x y z\nl1 l2\nl1 l2\n \nq"
    df = spark.createDataFrame([(1, t, "en", "s")], "doc_id long, text string, lang string, source string")
    r = rules.quality_rules(df).first()
    assert (r.n_repeat_words, r.n_dup_lines, r.n_words) == (17, 1, 25)


def test_rules_filter_keeps_clean_rows_and_columns(spark, odd_docs, no_docs):
    clean = "Every one of these words is quite plain and this line has more than ten of them in number {}"
    rows = [(i, clean.format(i), "en", "a") for i in range(60)] + [(100 + i, ("junk### more$$$ words%%% here&&& " * 3) + str(i) + " x y z u v w", "en", "a") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in rules.quality_filter(df).collect()}
    assert kept == set(range(60))
    assert rules.quality_filter(odd_docs).columns == odd_docs.columns
    assert rules.quality_filter(no_docs).count() == 0 and rules.quality_rules(no_docs).count() == 0


def fill(sizes, weights, cap):
    """Reference water-filling: clamp and share again until none is above."""
    total, out, open_ = sum(sizes), {}, list(range(len(sizes)))
    left = float(total)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            out.update(share)
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1000, 5, 300, 2, 90], [0, 10], [7], [1, 1, 1, 10000]])
def test_targets(spark, sizes):
    rows = [(f"s{i}" if i else None, n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    want = fill([n for _, n in order], weights, 3)
    assert [got[s] for s, _ in order] == pytest.approx(want)


def test_mix(spark, odd_docs, no_docs):
    rows = mixing.mixed_sizes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixed_sizes(odd_docs.repartition(7)).collect()), key=repr)
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mixed(odd_docs).count() == sum(r.copies for r in rows)
    assert mixing.mixed(no_docs).count() == 0 and mixing.mixed_sizes(no_docs).count() == 0
    many = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    taken = mixing.mixed_sizes(many).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 7 for r in taken)
    rng = random.Random(12)
    uneven = spark.createDataFrame([(i, "w " * int(10 * rng.paretovariate(1.6)), f"s{i % 12:02d}") for i in range(600)], "doc_id long, text string, source string")
    taken = mixing.mixed_sizes(uneven).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 0.03 * r.target for r in taken)


def brute(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, names = low(t), set(), set()
        for k, x in items:
            v = low(x)
            n = min(13, len(v))
            if not n or k is None:
                continue
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names.add(str(k))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, odd_docs, no_docs):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(10, passage), (9, "Lazy, DOG!"), (2, "été"), (None, "quick brown"), (3, None), (4, "..."), (10, passage)]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(20, "x " + passage.upper() + " y"), (21, "one two three four five six seven eight nine ten eleven twelve"), (22, passage + " " + passage), (23, passage[4:] + " one " + passage), (24, "lazy"), (25, "dog lazy"), (26, "lazy dog " * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontam.report(d, b).collect()), key=repr)
    assert got == brute(docs, items)
    longest = {r.doc_id: r.longest_match for r in decontam.report(d, b).collect()}
    assert longest[20] == longest[22] == 15 and longest[23] == 15 and longest[24] == 0
    limit, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 60  # several blocks give the same
    try:
        assert sorted((tuple(r)[:6] for r in decontam.report(d, b).collect()), key=repr) == brute(docs, items)
    finally:
        decontam.BLOCK_BYTES = limit
    spans = {r.doc_id: r.hit_spans for r in decontam.report(d, b).collect()}
    assert (spans[20], spans[21], spans[22], spans[26]) == ("1-16", "", "0-30", "0-6")
    stay = {r.doc_id for r in decontam.decontaminated(d, b).collect()}
    assert not stay & {20, 22, 23, 26} and {21, 24, 25} <= stay
    assert decontam.report(odd_docs, b.limit(0)).where("contaminated").count() == 0
    assert decontam.report(no_docs, b).count() == 0
    kept = decontam.decontaminated(odd_docs, b)
    assert kept.columns == odd_docs.columns and 3 in {r.doc_id for r in kept.collect()}


def test_decontamination_of_long_texts_and_many_blocks(spark, monkeypatch):
    """A passage of 13 words in a text of 2000 goes; blocks are made one at a time and give what one block gives."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 13, 20, 40])))) for i in range(120)] + [(200, "v1")]
    long = [rng.choice(vocabulary) for _ in range(2000)]
    thirteen = next(t for _, t in items if len(t.split()) == 20).split()[3:16]
    docs = [(0, " ".join(long[:900] + thirteen + long[900:])), (1, " ".join(long + ["v1"]))] + [(i, " ".join([rng.choice(vocabulary) for _ in range(60)] + items[i][1].split()[: rng.randrange(1, 41)])) for i in range(2, 60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((tuple(r) for r in decontam.report(d, b).collect()), key=repr)
    assert [r[:6] for r in one] == brute(docs, items)
    stay = {r.doc_id for r in decontam.decontaminated(d, b).collect()}
    assert 0 not in stay and 1 in stay
    built, make = [], decontam.block
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    monkeypatch.setattr(decontam, "block", lambda rows: built.append(sum(len(t) for _, t in rows)) or make(rows))
    assert sorted((tuple(r) for r in decontam.report(d, b).collect()), key=repr) == one
    assert len(built) >= 20 and max(built) < 3000


def test_scratch(spark, tmp_path, monkeypatch):
    table = scratch.staged(spark.range(3).toDF("x"), "kept")
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    scratch.staged(spark.range(3).toDF("x"), "gone")
    assert list((tmp_path / "strandloom").rglob("*.parquet"))
    scratch.clear(spark)
    assert not list((tmp_path / "strandloom").rglob("*.parquet")) and table.count() == 3


def test_folder_where_none_is_set():
    class Bare:
        def __init__(self, master):
            self.sparkContext, self.conf = self, self
            self.master, self.applicationId = master, f"app-{master}"

        def get(self, key, default=None):
            return default

        def getConf(self):
            return self

    one = scratch.shared_dir(Bare("local[4]"))
    assert one.startswith("file:///") and scratch.shared_dir(Bare("local[4]")) == one
    for cluster in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(Bare(cluster))
