"""Near-duplicate classes by BagMinHash, banding and verified multiset overlap.

A text is the multiset of its five-word shingles (all its words, if fewer).  Two
texts are linked if the weighted Jaccard similarity of these multisets is at least
0.8; classes are the connected components.

*Signatures.*  A shingle's weight, its count, is discretised in unit levels, which are
grouped in octaves [0,1), [1,2), [2,4), [4,8) ...  Each octave of a shingle has one Poisson process whose
rate is the octave's width; each of its points falls on a random level and on a random
signature slot, and counts if its level is below the weight.  A slot's value is its earliest point, and
two signatures agree in a slot with exactly the weighted Jaccard similarity as
probability.  Points come in order of time and stop at the latest slot, so that long texts cost about
one point a shingle.

*Bands.*  25 bands of 5 slots: a pair at 0.8 is missed with odds of 5e-5.

*Verification.*  Equal texts collapse first.  In each bucket the text in the middle, the one that shares
most buckets with most others, leads, and all others are verified against it, on the words
themselves; so a bucket of n near copies takes n pairs, not n squared.  Texts of buckets that still
hold several classes are compared in blocks: a block gets the shingles of its rows, computes their weighted
Jaccard similarities exactly, and returns a spanning forest of the links, one link less than it has rows at
most.  Those links are verified on the words too.  So no pair of a bucket is ruled out by an estimate, and
what is written grows with the rows.  The comparing itself is quadratic in the texts of a bucket that are not
alike enough to be joined by their leader; it is done as matrix products within blocks.

A unit of comparison is a bucket or, where that sends fewer rows, all buckets that hang together.

The nodes are texts, not ids: rows with equal texts are one node, and different texts under one id
are judged each by itself.  Texts without words (null, empty, blank) are classes of their own.  A
row with a null id gets a null class and joins nothing.  Very long texts are read whole; a block holds at most
``BLOCK_CODES`` shingles, or two texts.  An empty table gives no rows.  Other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
ROUNDS = 1
BLOCK = 1024  # rows of a unit compared at a time, with as many others
BLOCK_CODES = 2_000_000  # shingles in a block
SALT = 512  # pairs of a leader that are verified together
#: Ids that are broadcast at most (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 400_000
_TABLE = tx.byte_table()
_U = np.uint64


def signature(shingles: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signature (arrival times) of a multiset of 64-bit shingle codes."""
    x, weight = np.unique(shingles, return_counts=True)
    seeds, widths, room = [x], [np.ones(len(x))], [np.ones(len(x))]
    octave, low = 1, 1
    while (more := weight > low).any():
        seeds.append(tx.mix(x[more] ^ _U(octave * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        widths.append(np.full(int(more.sum()), float(low)))
        room.append(np.minimum(weight[more] - low, low).astype(float))
        octave, low = octave + 1, low * 2
    seed, width, room = np.concatenate(seeds), np.concatenate(widths), np.concatenate(room)
    best = np.full(slots, np.inf)
    time, step = np.zeros(len(seed)), 0
    take = int(np.ceil(slots * (np.log(slots) + 1) / max(width.sum(), 1.0)))
    while len(seed):
        take = min(max(take, 1), max(1, (1 << 16) // len(seed)))
        codes = tx.mix(seed[:, None] + (np.arange(step, step + take, dtype=_U) * _U(0xD1342543DE82EF95)))
        step += take
        # The upper 40 bits give the waiting time, the lower 24 bits, mixed anew, slot and level.
        gaps = -np.log(((codes >> _U(24)).astype(float) + 0.5) * 2.0**-40) / width[:, None]
        gaps[:, 0] += time  # added up one by one, so that blocks of any length give the same sums
        times = np.cumsum(gaps, axis=1)
        time = times[:, -1].copy()
        more = tx.mix(codes ^ _U(0x2545F4914F6CDD1D))
        slot = (more % _U(slots)).astype(np.int64)
        counts = times < best.max()
        if room.min() < width.max():
            counts &= np.floor((more >> _U(40)).astype(float) * 2.0**-24 * width[:, None]) < room[:, None]
        np.minimum.at(best, slot[counts], times[counts])
        alive = time < best.max()
        if not alive.all():
            seed, width, room, time = seed[alive], width[alive], room[alive], time[alive]
        take = max(1, take // 4)
    return best


def bands(times: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One signed 64-bit code a band."""
    parts = tx.mix(times.view(_U)).reshape(n, -1)
    out = np.arange(1, n + 1, dtype=_U)
    for column in parts.T:
        out = tx.mix(out * _U(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _digest(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, bands); texts without words have neither digest nor bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tx.tokenise(batch.column(1), _TABLE):
                codes = []
                for i in range(len(w.first) - 1):
                    words = w.hash[w.first[i] : w.first[i + 1]]
                    codes.append(bands(signature(tx.windows(words, min(SHINGLE, len(words))))) if len(words) else None)
                n = len(codes)
                digests = [d if c is not None else None for d, c in zip(batch.column(2).slice(w.row, n).to_pylist(), codes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, n), pa.array(digests, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])

    body = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    return body.withColumn("digest", _digest(F.col("text"))).mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def multiset(text: bytes) -> Counter:
    words = text.split()
    n = min(SHINGLE, len(words))
    return Counter(zip(*[words[i : len(words) - n + 1 + i] for i in range(n)], strict=True)) if n else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: sum of least over sum of largest counts."""
    if len(a) > len(b):
        a, b = b, a
    least = sum(min(n, b[x]) for x, n in a.items() if x in b)
    most = sum(a.values()) + sum(b.values()) - least
    return least / most if most else 0.0


def _few(ids: DataFrame) -> bool:
    return ids.count() <= BROADCAST_IDS


def _members(reps: DataFrame) -> DataFrame:
    """(bucket, id) of buckets with two documents or more."""
    rows = reps.select(F.explode("bands").alias("bucket"), F.col("id"))
    several = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket")
    return staged(rows.join(several, "bucket", "left_semi"), "minhash-members")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.  texts: (id, body).  A hot a is dealt to several tasks."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    left = texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")).join(salts, "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "body_a")
    right = texts.select(F.col("id").alias("b"), F.col("body").alias("body_b"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(3)), F.col("salts")).alias("salt"))
    both = salted.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, Counter()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:  # a join by sorting brings the rows of a leader together
                    last, known = a, multiset(x.as_py())
                keep.append(similarity(known, multiset(y.as_py())) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """A code for each element of a multiset: the second, third ... occurrence of a shingle have codes of their own.

    So two multisets have as many codes in common as elements.
    """
    x = np.sort(shingles)
    if len(x) < 2:
        return x
    new = np.concatenate([[True], x[1:] != x[:-1]])
    place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return np.where(place > 0, tx.mix(x + place.astype(_U) * _U(0xD1342543DE82EF95)), x)


def _codes(texts: DataFrame) -> DataFrame:
    """(id, size, codes) of each text: its shingles as :func:`occurrences`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tx.tokenise(batch.column(1), _TABLE):
                n = len(w.first) - 1
                found = []
                for i in range(n):
                    words = w.hash[w.first[i] : w.first[i + 1]]
                    found.append(occurrences(tx.windows(words, min(SHINGLE, len(words)))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, n), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "size", "codes"])

    return texts.select("id", "body").mapInArrow(run, "id long, size long, codes binary")


def overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many codes each row of ``left`` has in common with each of ``right`` (places in rows)."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(x) for x in rows])
    code = np.concatenate(rows)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    many = np.diff(np.concatenate([first, [len(code)]]))
    first, many = first[many > 1], many[many > 1]
    out = np.zeros((len(left), len(right)))
    if not len(first):
        return out
    # Codes that stand in the same rows count together.
    inside = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    owner = owner[inside]
    bounds = np.concatenate([[0], np.cumsum(many)])
    marks = tx.mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    _, pick, weight = np.unique(np.add.reduceat(marks[owner], bounds[:-1]), return_index=True, return_counts=True)
    many = many[pick]
    place_l, place_r = np.full(n, -1), np.full(n, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    dense = np.flatnonzero(many > max(8, n // 8))
    for low in range(0, len(dense), 1024):
        part = dense[low : low + 1024]
        x = np.zeros((n, len(part)), np.float32)
        for k, c in enumerate(part):
            x[owner[bounds[pick[c]] : bounds[pick[c]] + many[c]], k] = 1
        out += (x[left] * weight[part].astype(np.float32)) @ x[right].T
    thin = np.flatnonzero(many <= max(8, n // 8))
    for m in np.unique(many[thin]):
        these = thin[many[thin] == m]
        step = max(1, (1 << 22) // int(m * m))
        for low in range(0, len(these), step):
            part = these[low : low + step]
            who = owner[bounds[pick[part]][:, None] + np.arange(m)]
            one, two = np.repeat(who, m, axis=1).ravel(), np.tile(who, (1, m)).ravel()
            ok = (place_l[one] >= 0) & (place_r[two] >= 0)
            at = place_l[one[ok]] * len(right) + place_r[two[ok]]
            out += np.bincount(at, weights=np.repeat(weight[part].astype(float), m * m)[ok], minlength=out.size).reshape(out.shape)
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links, as places (i, j), that join what ``linked`` (left x right) joins; rows of one label are joined already."""
    root = np.unique(label, return_inverse=True)[1]
    out = []
    for k in np.flatnonzero(linked.any(axis=1)):
        i = left[k]
        js = right[linked[k]]
        roots, first = np.unique(root[js], return_index=True)
        for r, j in zip(roots.tolist(), js[first].tolist(), strict=True):
            if r != root[i]:
                out.append((int(i), j))
                root[root == r] = root[i]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each pair of blocks.  Rows come sorted by unit, x and y; side 2 is a block with itself."""
    held: list[pa.RecordBatch] = []

    def settle() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ids, label, side = (rows.column(c).to_numpy() for c in ("id", "label", "side"))
        codes = [np.frombuffer(x, _U) for x in rows.column("codes").to_pylist()]
        size = np.array([len(x) for x in codes], float)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        pairs: list[tuple[int, int]] = []
        if len(left) and len(right) and (label != label[0]).any():
            common = overlaps(codes, left, right)
            linked = common >= (SIMILARITY - 1e-9) * (size[left][:, None] + size[right] - common)
            linked &= label[left][:, None] != label[right]
            pairs = forest(linked, left, right, label)
        a, b = ids[[i for i, _ in pairs]], ids[[j for _, j in pairs]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    last = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("whole", "unit", "x", "y")], strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high == low:
                continue
            if held and last != keys[low]:
                yield settle()
                held.clear()
            last = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield settle()


def _rest(state: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join what is similar enough in any bucket.  state: (bucket, id, label).

    Units are buckets, or the components of buckets that share rows where that sends fewer rows; a unit is cut
    in blocks, and each pair of blocks is one group.
    """
    state = staged(state, "minhash-rest")
    least = state.groupBy("bucket").agg(F.min("id").alias("least"))
    part = components(state.join(least, "bucket").select(F.col("id").alias("a"), F.col("least").alias("b"))).select("id", F.col("label").alias("part"))
    codes = staged(_codes(texts.join(state.select("id").distinct(), "id", "left_semi")), "minhash-codes")
    rows = staged(state.join(part, "id").join(codes.select("id", "size"), "id"), "minhash-units")

    def blocks(table: DataFrame, key: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_CODES), F.lit(1)).cast("int")
        return table.groupBy(key).agg(n.alias("n"), F.count(F.lit(1)).alias("rows"))

    by_bucket = blocks(rows, "bucket")
    singles = rows.select("part", "id", "label", "size").distinct()
    by_part = blocks(singles, "part")
    cost = rows.select("bucket", "part").distinct().join(by_bucket, "bucket").groupBy("part").agg(F.sum(F.col("rows") * F.col("n")).alias("cost"))
    whole = staged(by_part.join(cost, "part").select("part", "n", (F.col("rows") * F.col("n") <= F.col("cost")).alias("whole")), "minhash-parts")
    one = singles.join(whole.where("whole").select("part", "n"), "part").select(F.lit(True).alias("whole"), F.col("part").alias("unit"), "n", "id", "label")
    two = rows.join(whole.where("NOT whole").select("part"), "part", "left_semi").join(by_bucket.select("bucket", "n"), "bucket").select(F.lit(False).alias("whole"), F.col("bucket").alias("unit"), "n", "id", "label")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int")
    group = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), F.when(o == mine, 2).when(mine < o, 0).otherwise(1).alias("side"))))
    dealt = one.unionByName(two).select("whole", "unit", group.alias("g"), "id", "label").select("whole", "unit", "g.x", "g.y", "g.side", "id", "label")
    dealt = dealt.join(codes.select("id", "codes"), "id").repartition("whole", "unit", "x", "y").sortWithinPartitions("whole", "unit", "x", "y")
    return dealt.mapInArrow(_compared, "a long, b long").distinct()


def links(members: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(id, label) of all texts with a verified link.  members: (bucket, id); texts: (id, body)."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    # Texts that share many buckets with many others stand in the middle of their group.
    middle = members.join(sizes, "bucket").groupBy("id").agg(F.sum("rows").alias("middle"))
    state = staged(members.join(middle, "id").withColumn("label", F.col("id")), "minhash-state")
    edges = None
    for _ in range(ROUNDS):
        first = F.max(F.struct("middle", F.xxhash64("id").alias("h"), "id", "label"))
        lead = state.groupBy("bucket").agg(first.alias("lead")).select("bucket", F.col("lead.id").alias("leader"), F.col("lead.label").alias("head"))
        led = staged(state.join(lead, "bucket"), "minhash-led")
        pairs = staged(led.where("label <> head").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "minhash-pairs")
        found = staged(verified(pairs, texts, threshold), "minhash-edges")
        edges = found if edges is None else edges.unionByName(found)
        label = components(edges)
        state = led.where("id <> leader").drop("label", "leader", "head").join(label, "id", "left").select("bucket", "id", "middle", F.coalesce("label", "id").alias("label"))
        several = state.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
        state = staged(state.join(several.select("bucket"), "bucket", "left_semi"), "minhash-state")
        if not state.limit(1).count():
            return label
    rest = staged(_rest(state.select("bucket", "id", "label"), texts), "minhash-links")
    return components(edges.unionByName(staged(verified(rest, texts, threshold), "minhash-edges")))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id, digest), one row a row of ``docs``: the class is the smallest id of its texts.

    Where different texts stand under one id, the classes of both may have that id.
    """
    return _labelled(docs, text).drop("head")


def _labelled(docs: DataFrame, text: str) -> DataFrame:
    """``classes`` and, where ids repeat, the digest of the text that a class is named by."""
    sig = staged(signatures(docs, text), "minhash-signatures")
    repeats = _repeats(sig)
    same = sig.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    # An id is its text's node, unless ids repeat.
    node = F.monotonically_increasing_id() if repeats else F.col("r.doc_id").cast("long")
    reps = staged(same.select("digest", F.col("r.doc_id").alias("doc_id"), "r.bands", node.alias("id")), "minhash-reps")
    members = _members(reps)
    ids = members.select("id").distinct()
    wanted = staged(reps.join(ids, "id", "left_semi").select("id", "doc_id", "digest"), "minhash-ids")
    few = F.broadcast(wanted) if _few(wanted) else wanted
    body = docs.select("doc_id", F.col(text).cast("binary").alias("body")).where("body IS NOT NULL")
    if repeats:
        texts = body.withColumn("digest", _digest(F.col("body"))).join(few, ["doc_id", "digest"]).select("id", "body").dropDuplicates(["id"])
    else:
        texts = body.join(few.select("doc_id", "id"), "doc_id").select("id", "body")
    label = links(members, staged(texts, "minhash-texts"))
    named = reps.select("digest", "id", "doc_id").join(label, "id", "left").select("digest", "doc_id", F.coalesce("label", "id").alias("label"))
    if repeats:  # nodes are no ids
        least = named.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
        named = named.join(least, "label").select("digest", F.col("least.doc_id").alias("class_id"), F.col("least.digest").alias("head"))
    else:
        named = named.select("digest", F.col("label").alias("class_id"), F.lit(None).cast("binary").alias("head"))
    return sig.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "digest", "head")


def _repeats(sig: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return bool(sig.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, and of texts under that id the smallest digest.

    Equal rows of that id and text are reduced to one.  Rows with a null id or without words all stay.
    """
    label = staged(_labelled(docs, text), "minhash-classes")
    if not _repeats(label):
        gone = label.where("class_id < doc_id").select("doc_id")
        return docs.join(F.broadcast(gone) if _few(gone) else gone, "doc_id", "left_anti").select(*docs.columns)
    first = label.where("class_id = doc_id AND digest = head").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.col(text).cast("binary").alias("_body"))
    idle = F.col("_id").isNull() | F.coalesce(~F.col("_body").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    worded = packed.where(~idle).select("row", "_id", _digest(F.col("_body")).alias("_digest"))
    kept = worded.join(first, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(packed.where(idle).select("row.*"))
