"""The registered queries and the SQL that gives the same results.

Sequences are the letters a, c, g and t of whole texts, in upper case.  Pairwise queries
run over the whole ``benchmark`` table, and searches take the documents whose id is divisible by 100 against all rows;
``knn_levenshtein`` takes all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.weights import TRANSFORMS, mismatch_weights, transformed
from ..operators.ann import ANNIndex
from ..operators.distance import KERNEL_TRANSFORMS, DistanceKernel, Hamming, Levenshtein, NeedlemanWunsch, SmithWaterman
from ..operators.encoders import GappyEncoder, MismatchEncoder, SpectrumEncoder, deltas, generate_masks
from ..operators.gkm import GKMKernel, WGKMKernel, WindowedGKMKernel, WindowedWGKMKernel
from ..operators import analysis
from ..operators.models import DifferentialKmerScorer, KernelSVM, KNNClassifier, LinearSVM
from ..operators.perturb import Chunker, KmerShuffler
from ..sources.tables import benchmark_sequences, document_sequences, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- SQL parts --------------------------------------------------------------

_DOCS = "docs AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS seq FROM documents)"
_ITEMS = "items AS (SELECT item_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS seq FROM benchmark)"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _code(x: str, k: int) -> str:
    """The packed code of a k-mer."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def _windows(name: str, source: str, k: int, extra: str = "") -> str:
    """CTE (seq_id, i, kmer, n): windows of k letters, i from 0."""
    return f"{name} AS (SELECT seq_id, i::INT AS i, substr(seq, i::INT + 1, {k}) AS kmer, length(seq) AS n{extra} FROM (SELECT *, unnest(range(0, greatest(length(seq) - {k - 1}, 0))) AS i FROM {source}))"


def _case(weights: list[float]) -> str:
    return "CASE h " + " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(weights)) + " END"


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


# --- sequences --------------------------------------------------------------


@_add("dna_sequences", f"WITH {_DOCS} SELECT seq_id, seq, length(seq)::BIGINT AS n_letters FROM docs")
def dna_sequences(spark, sf_dir):
    return document_sequences(spark, sf_dir).select("seq_id", sq.checked(F.col("seq")).alias("seq"), F.length("seq").cast("long").alias("n_letters"))


@_add("reverse_complement", f"WITH {_DOCS} SELECT seq_id, {_rc('seq')} AS rc FROM docs")
def reverse_complement(spark, sf_dir):
    return document_sequences(spark, sf_dir).select("seq_id", sq.col_reverse_complement(F.col("seq")).alias("rc"))


@_add(
    "kmer_code_roundtrip",
    f"""WITH {_ITEMS}, {_windows('w', 'items', 6)}
    SELECT DISTINCT seq_id, kmer, {_code('kmer', 6)}::BIGINT AS code, {_code(_rc('kmer'), 6)}::BIGINT AS rc_code, {_code(f'least(kmer, {_rc("kmer")})', 6)}::BIGINT AS canonical, kmer <= {_rc('kmer')} AS is_canonical, kmer AS back FROM w""",
)
def kmer_code_roundtrip(spark, sf_dir):
    kmers = benchmark_sequences(spark, sf_dir).select("seq_id", F.explode(sq.col_kmers(F.col("seq"), 6)).alias("kmer")).distinct()
    code = sq.col_code(F.col("kmer"))
    return kmers.select("seq_id", "kmer", code.alias("code"), sq.col_packed_rc(code, 6).alias("rc_code"), sq.col_canonical_code(code, 6).alias("canonical"), sq.col_is_canonical(F.col("kmer")).alias("is_canonical"), sq.col_kmer(code, 6).alias("back"))


# --- encoders ---------------------------------------------------------------


def _encoder_query(name: str, make: Callable, sql: str) -> None:
    @_add(name, sql)
    def run(spark, sf_dir):
        return make().transform(document_sequences(spark, sf_dir)).select("seq_id", "feature", "cnt")


for _k in (4, 6):
    _encoder_query(f"spectrum_k{_k}", lambda k=_k: SpectrumEncoder(k), f"WITH {_DOCS}, {_windows('w', 'docs', _k)} SELECT seq_id, kmer AS feature, count(*)::BIGINT AS cnt FROM w GROUP BY ALL")
_encoder_query("spectrum_canonical_k4", lambda: SpectrumEncoder(4, canonical_rc=True), f"WITH {_DOCS}, {_windows('w', 'docs', 4)} SELECT seq_id, least(kmer, {_rc('kmer')}) AS feature, count(*)::BIGINT AS cnt FROM w GROUP BY ALL")


@_add(
    "spectrum_columns_k4",
    f"WITH {_DOCS}, {_windows('w', 'docs', 4)} SELECT seq_id, {_code('kmer', 4)}::INT AS col, count(*)::BIGINT AS cnt FROM w GROUP BY ALL",
)
def spectrum_columns_k4(spark, sf_dir):
    return SpectrumEncoder(4).transform(document_sequences(spark, sf_dir)).select("seq_id", "col", "cnt")


@_add(
    "feature_dictionary_k4",
    f"""WITH a AS (SELECT unnest(['A','C','G','T']) AS c), k AS (SELECT a.c || b.c || d.c || e.c AS kmer FROM a, a AS b, a AS d, a AS e)
    SELECT (row_number() OVER (ORDER BY kmer) - 1)::INT AS col, kmer AS feature FROM k WHERE kmer <= {_rc('kmer')}""",
)
def feature_dictionary_k4(spark, sf_dir):
    return SpectrumEncoder(4, canonical_rc=True).dimension(spark)


def _gappy_sql(masks: list[str], canonical: bool = False) -> str:
    parts = []
    for m in masks:
        picked = " || ".join(f"substr(kmer, {i + 1}, 1)" for i, c in enumerate(m) if c == "*")
        name = f"least({picked}, {_rc(f'({picked})')})" if canonical and m == m[::-1] else picked
        parts.append(f"SELECT seq_id, '{m}_' || {name} AS feature FROM (WITH {_windows('w', 'docs', len(m))} SELECT * FROM w)")
    return f"WITH {_DOCS} SELECT seq_id, feature, count(*)::BIGINT AS cnt FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_encoder_query("gappy_single", lambda: GappyEncoder(["*--*"]), _gappy_sql(["*--*"]))
_encoder_query("gappy_range", lambda: GappyEncoder(L=4, g_min=1, g_max=2), _gappy_sql(generate_masks(4, 4, 1, 2)))
_encoder_query("gappy_canonical", lambda: GappyEncoder(["*-*", "**-*", "*-**"], canonical_rc=True), _gappy_sql(["*-*", "**-*"], True))


def _mismatch_sql(k: int, m: int, feature: str = "kmer", where: str = "true") -> str:
    changes = ", ".join(f"({int(x)})" for x in deltas(k, m)[0])
    letters = " || ".join(f"substr('ACGT', ((code >> {2 * (k - 1 - i)}) & 3)::INT + 1, 1)" for i in range(k))
    return f"""WITH {_DOCS}, {_windows('w', 'docs', k)}, c AS (SELECT seq_id, {_code('kmer', k)}::BIGINT AS code, count(*) AS n FROM w GROUP BY ALL),
    x AS (SELECT seq_id, xor(c.code, d.x::BIGINT) AS code, n FROM c, (VALUES {changes}) AS d(x)), y AS (SELECT seq_id, {letters} AS kmer, n FROM x)
    SELECT seq_id, {feature} AS feature, sum(n)::BIGINT AS cnt FROM y WHERE {where} GROUP BY ALL"""


for _m in (1, 2):
    _encoder_query(f"mismatch_k4_m{_m}", lambda m=_m: MismatchEncoder(4, m), _mismatch_sql(4, _m))
_encoder_query("mismatch_canonical_k4_m1", lambda: MismatchEncoder(4, 1, canonical_rc=True), _mismatch_sql(4, 1, f"least(kmer, {_rc('kmer')})"))
_encoder_query("mismatch_canonical_legacy_k4_m1", lambda: MismatchEncoder(4, 1, canonical_rc=True, legacy_drop=True), _mismatch_sql(4, 1, where=f"kmer <= {_rc('kmer')}"))


@_add(
    "mismatch_density",
    " UNION ALL ".join(f"SELECT {m} AS m, count(*)::BIGINT AS n_nonzero, sum(cnt)::BIGINT AS total FROM ({_mismatch_sql(4, m)})" for m in (0, 1, 2)),
)
def mismatch_density(spark, sf_dir):
    docs, out = document_sequences(spark, sf_dir), None
    for m in (0, 1, 2):
        part = MismatchEncoder(4, m).transform(docs).agg(F.lit(m).alias("m"), F.count(F.lit(1)).alias("n_nonzero"), F.sum("cnt").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


# --- gapped k-mer kernels ---------------------------------------------------

_L, _K, _D = 6, 4, 2


def _long(df: DataFrame, n: int = _L) -> DataFrame:
    return df.where(F.length("seq") >= n)


def _pairs_sql(x: str, y: str, by: str, weights: list[float]) -> str:
    """Sum over pairs of rows (seq_id, by, kmer, n) of x and y, from the distinct k-mers' distances."""
    on = f"AND a.{by} = b.{by}" if by else ""
    g = f", a.{by}" if by else ""
    return f"""(WITH p AS (SELECT a.kmer AS ka, b.kmer AS kb, hamming(a.kmer, b.kmer) AS h FROM (SELECT DISTINCT kmer FROM {x}) a, (SELECT DISTINCT kmer FROM {y}) b),
      pw AS (SELECT ka, kb, {_case(weights)} AS w FROM p WHERE h <= {len(weights) - 1})
      SELECT a.seq_id AS q_id, b.seq_id AS r_id{g}, sum(a.n * b.n * w) AS raw FROM {x} a JOIN pw ON a.kmer = pw.ka JOIN {y} b ON b.kmer = pw.kb {on} GROUP BY ALL)"""


def _norm_sql(x: str, y: str, by: str, weights: list[float]) -> str:
    on = f"AND a.{by} = b.{by}" if by else ""
    g = f", a.{by}" if by else ""
    return f"""(SELECT seq_id{g.replace('a.', '')}, sqrt(greatest(0, sum(m * {_case(weights)}))) AS norm FROM
      (SELECT a.seq_id{g}, a.n * b.n AS m, hamming(a.kmer, b.kmer) AS h FROM {x} a JOIN {y} b ON a.seq_id = b.seq_id {on}) WHERE h <= {len(weights) - 1} GROUP BY ALL)"""


def _kernel_sql(queries: str, refs: str, weights: list[float], *, use_rc: bool, by: str = "", value: str = "k", head: str = "", same: bool = False) -> str:
    """K of rows (seq_id, by, kmer, n) of tables {queries}_f (forward) and {refs}_f, with their reverse strands.

    queries and refs name CTEs in ``head`` of (seq_id, by, kmer, pw).
    """
    g = f", {by}" if by else ""

    def sides(x: str, by: str) -> str:
        g = f", {by}" if by else ""
        both = f"SELECT seq_id{g}, kmer, pw FROM {x} UNION ALL SELECT seq_id{g}, {_rc('kmer')}, pw FROM {x}" if use_rc else f"SELECT seq_id{g}, kmer, pw FROM {x}"
        return f"{x}_f AS (SELECT seq_id{g}, kmer, sum(pw)::DOUBLE AS n FROM {x} GROUP BY ALL), {x}_b AS (SELECT seq_id{g}, kmer, sum(pw)::DOUBLE AS n FROM ({both}) GROUP BY ALL), {x}_n AS {_norm_sql(f'{x}_f', f'{x}_b', by, weights)}"

    ctes = [sides(queries, by)] + ([sides(refs, by if same else "")] if refs != queries else [])
    join = f"JOIN {refs}_n r ON q.{by} = r.{by}" if by and same else f"CROSS JOIN {refs}_n r"
    grid = f"SELECT q.seq_id AS q_id, r.seq_id AS r_id{', q.' + by if by else ''}, q.norm AS qn, r.norm AS rn FROM {queries}_n q {join}"
    raw = _pairs_sql(f"{queries}_f", f"{refs}_b", by if same else "", weights) if not by or same else None
    if raw is None:  # windows of the query against whole references
        raw = f"""(WITH p AS (SELECT a.kmer AS ka, b.kmer AS kb, hamming(a.kmer, b.kmer) AS h FROM (SELECT DISTINCT kmer FROM {queries}_f) a, (SELECT DISTINCT kmer FROM {refs}_b) b),
          pw AS (SELECT ka, kb, {_case(weights)} AS w FROM p WHERE h <= {len(weights) - 1})
          SELECT a.seq_id AS q_id, b.seq_id AS r_id, a.{by}, sum(a.n * b.n * w) AS raw FROM {queries}_f a JOIN pw ON a.kmer = pw.ka JOIN {refs}_b b ON b.kmer = pw.kb GROUP BY ALL)"""
    keys = f"q_id, r_id{g}"
    return f"""WITH {head}, {', '.join(ctes)}, grid AS ({grid}), raw AS {raw},
    kk AS (SELECT {keys}, CASE WHEN qn > 0 AND rn > 0 THEN coalesce(raw, 0) / (qn * rn) ELSE 0 END AS k FROM grid LEFT JOIN raw USING ({keys}))
    SELECT {keys}, {value} FROM kk"""


_ROUNDED = "round(k, 6) + 0.0 AS k"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six decimals, and no negative zero."""
    names = names or ("k",)
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


_ITEM_WINDOWS = f"{_ITEMS}, lit AS (SELECT * FROM items WHERE length(seq) >= {_L}), {_windows('iw0', 'lit', _L)}, iw AS (SELECT seq_id, kmer, 1.0::DOUBLE AS pw FROM iw0)"
_DOC_WINDOWS = f"{_DOCS}, ldt AS (SELECT * FROM docs WHERE length(seq) >= {_L}), {_windows('dw0', 'ldt', _L)}, dw AS (SELECT seq_id, kmer, 1.0::DOUBLE AS pw FROM dw0)"


@_add("gkm_full_rc", _kernel_sql("dw", "iw", mismatch_weights(_L, _K, _D), use_rc=True, value=_ROUNDED, head=f"{_DOC_WINDOWS}, {_ITEM_WINDOWS}"))
def gkm_full_rc(spark, sf_dir):
    """All documents against all benchmark items, both strands."""
    kernel = GKMKernel(_L, _K, _D, use_rc=True).set_references(_long(benchmark_sequences(spark, sf_dir)))
    return _rounded(kernel.kernel(X_query=_long(document_sequences(spark, sf_dir))))


def _self_query(name: str, scheme: str, strategy: str, use_rc: bool) -> None:
    @_add(name, _kernel_sql("iw", "iw", mismatch_weights(_L, _K, _D, scheme), use_rc=use_rc, value=_ROUNDED, head=_ITEM_WINDOWS))
    def run(spark, sf_dir):
        kernel = GKMKernel(_L, _K, _D, kernel_type=scheme, use_rc=use_rc, strategy=strategy)
        return _rounded(kernel.set_references(_long(benchmark_sequences(spark, sf_dir))).kernel())


_self_query("gkm_full_norc", "full", "auto", False)
_self_query("gkm_truncated", "truncated", "auto", True)
_self_query("gkm_estimated", "estimated_full", "auto", True)
_self_query("gkm_by_neighbours", "full", "neighbours", True)
_self_query("gkm_by_blocks", "full", "blocks", True)

_TRANSFORM_SQL = {"linear": "k", "rbf": "exp(0.5 * (k - 1))", "poly": "power(0.5 * k + 0.1, 2)", "sigmoid": "tanh(0.5 * k + 0.1)", "exponential": "exp(-0.5 * ((1 - k) - 0.2))", "exponential_clipped": "exp(-0.5 * greatest(0, (1 - k) - 0.2))"}


@_add("gkm_transforms", _kernel_sql("iw", "iw", mismatch_weights(_L, _K, _D), use_rc=True, value=", ".join(f"round({x}, 6) + 0.0 AS k_{n}" for n, x in _TRANSFORM_SQL.items()), head=_ITEM_WINDOWS))
def gkm_transforms(spark, sf_dir):
    k = GKMKernel(_L, _K, _D, use_rc=True).set_references(_long(benchmark_sequences(spark, sf_dir))).kernel()
    names = [t for t in TRANSFORMS if t]
    out = k.select("q_id", "r_id", *[transformed(F.col("k"), t, 0.5, 0.1, 2, 0.2).alias(f"k_{t}") for t in names])
    return _rounded(out, *[f"k_{t}" for t in names])


@_add("kernel_distance_pairs", _kernel_sql("iw", "iw", mismatch_weights(_L, _K, _D), use_rc=True, value="round(sqrt(greatest(0, round(2 - 2 * k, 9))), 6) + 0.0 AS d", head=_ITEM_WINDOWS))
def kernel_distance_pairs(spark, sf_dir):
    k = GKMKernel(_L, _K, _D, use_rc=True).set_references(_long(benchmark_sequences(spark, sf_dir))).kernel()
    return _rounded(k.select("q_id", "r_id", F.sqrt(F.greatest(F.lit(0.0), F.round(2 - 2 * F.col("k"), 9))).alias("d")), "d")


def _window_cte(name: str, source: str, window: int, shift: int, left: int, right: int, pw: str = "1.0::DOUBLE") -> str:
    """CTE (seq_id, window_idx, kmer, pw): L-mers of each clipped window."""
    return f"""{name}_s AS (SELECT seq_id, seq, w::INT AS window_idx, greatest(0, w * {shift} - {left})::INT AS first, least(length(seq), w * {shift} - {left} + {window})::INT AS stop
      FROM (SELECT *, unnest(range(0, CASE WHEN length(seq) + {left + right} >= {window} THEN (length(seq) + {left + right - window}) // {shift} + 1 ELSE 0 END)) AS w FROM {source})),
    {name} AS (SELECT seq_id, window_idx, substr(seq, i::INT + 1, {_L}) AS kmer, {pw} AS pw FROM (SELECT *, unnest(range(first, greatest(stop - {_L - 1}, first))) AS i FROM {name}_s))"""


@_add(
    "gkm_sliding_scan",
    _kernel_sql("sw", "iw", mismatch_weights(_L, _K, _D), use_rc=True, by="window_idx", value=_ROUNDED, head=f"{_ITEM_WINDOWS}, scanned AS (SELECT * FROM items WHERE length(seq) >= 20), {_window_cte('sw', 'scanned', 20, 10, 0, 0)}"),
)
def gkm_sliding_scan(spark, sf_dir):
    items = benchmark_sequences(spark, sf_dir)
    kernel = GKMKernel(_L, _K, _D, use_rc=True).set_references(_long(items))
    return _rounded(kernel.sliding_window_query_kernel(_long(items, 20), window=20, shift=10))


@_add("scan_best_window", f"SELECT q_id, r_id, arg_max(window_idx, [k, -window_idx]) AS best_window, max(k) AS k FROM ({_SQL['gkm_sliding_scan']}) GROUP BY ALL")
def scan_best_window(spark, sf_dir):
    scan = gkm_sliding_scan(spark, sf_dir)
    return scan.groupBy("q_id", "r_id").agg(F.max_by("window_idx", F.struct("k", -F.col("window_idx"))).alias("best_window"), F.max("k").alias("k"))


_SCAN_SCORES = f"SELECT q_id, window_idx, round(sum(k * (r_id % 5 - 2)), 6) + 0.25 AS score FROM ({_SQL['gkm_sliding_scan']}) GROUP BY ALL"


@_add("scan_scores", _SCAN_SCORES)
def scan_scores(spark, sf_dir):
    """Windows scored by references whose coefficients are a rule of their id."""
    rule = benchmark_sequences(spark, sf_dir).select(F.col("seq_id").alias("r_id"), (F.col("seq_id") % 5 - 2).cast("double").alias("coef"))
    found = analysis.scan_scores(gkm_sliding_scan(spark, sf_dir), rule)
    return found.select("q_id", "window_idx", (F.round("score", 6) + 0.25).alias("score"))


@_add("scan_score_peaks", f"SELECT q_id, arg_max(window_idx, [score, -window_idx]) AS window_idx, max(score) AS score FROM ({_SCAN_SCORES}) GROUP BY q_id")
def scan_score_peaks(spark, sf_dir):
    return analysis.peaks(scan_scores(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str, size: int = 24) -> DataFrame:
    """Pieces of ``size`` letters that cover the benchmark sequences: the last one ends with its sequence and may overlap
    the one before; a shorter sequence is repeated up to the size."""
    seq = F.when(F.length("seq") < size, F.expr(f"left(repeat(seq, {size}), {size})")).otherwise(F.col("seq"))
    whole = benchmark_sequences(spark, sf_dir).where(F.length("seq") > 0).select("seq_id", seq.alias("seq"))
    pieces = whole.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.ceil(F.length("seq") / size).cast("int") - 1)).alias("i"))
    first = F.least(F.col("i") * size, F.length("seq") - size) + 1
    return pieces.select((F.col("seq_id") * 1000 + F.col("i")).alias("seq_id"), F.col("seq").substr(first, F.lit(size)).alias("seq"))


_CHUNKS = f"""{_ITEMS}, whole AS (SELECT seq_id, CASE WHEN length(seq) < 24 THEN substr(repeat(seq, 24), 1, 24) ELSE seq END AS seq FROM items WHERE length(seq) > 0),
chunks AS (SELECT seq_id * 1000 + i AS seq_id, substr(seq, least(i * 24, length(seq) - 24)::INT + 1, 24) AS seq FROM (SELECT *, unnest(range(0, (length(seq) + 23) // 24)) AS i FROM whole))"""


@_add("gkm_windowed_self", _kernel_sql("cw", "cw", mismatch_weights(_L, _K, _D), use_rc=True, by="window_idx", same=True, value=_ROUNDED, head=f"{_CHUNKS}, {_window_cte('cw', 'chunks', 12, 4, 0, 2)}"))
def gkm_windowed_self(spark, sf_dir):
    return _rounded(WindowedGKMKernel(_L, _K, _D, window=12, shift=4, padding=(0, 2), use_rc=True).set_references(_chunks(spark, sf_dir)).kernel())


@_add(
    "gkm_windowed_cross",
    _kernel_sql("qw", "cw", mismatch_weights(_L, _K, _D), use_rc=False, by="window_idx", same=True, value=_ROUNDED, head=f"{_CHUNKS}, q AS (SELECT * FROM chunks WHERE (seq_id // 1000) % 100 = 0), {_window_cte('qw', 'q', 12, 6, 0, 0)}, {_window_cte('cw', 'chunks', 12, 6, 0, 0)}"),
)
def gkm_windowed_cross(spark, sf_dir):
    """Pieces of items whose id is divisible by 100 against all pieces."""
    chunks = _chunks(spark, sf_dir)
    kernel = WindowedGKMKernel(_L, _K, _D, window=12, shift=6).set_references(chunks)
    return _rounded(kernel.kernel(X_query=chunks.where(F.floor(F.col("seq_id") / 1000) % 100 == 0)))


_POSITION_SQL = {"triangular": "greatest(0, 1 - abs(x) / 8.0)", "epanechnikov": "greatest(0, 1 - x * x / 64.0)", "gaussian": "exp(-(x * x) / 128.0)", "laplacian": "exp(-0.1 * abs(x))", "cauchy": "1 / (1 + x * x / 64.0)"}


def _weighted_cte(kind: str, centres: list[float]) -> str:
    rows = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(centres))
    return f"{_CHUNKS}, {_windows('pw0', 'chunks', _L)}, pw AS (SELECT seq_id, center_idx, kmer, ({_POSITION_SQL[kind]})::DOUBLE AS pw FROM (SELECT seq_id, c.i AS center_idx, kmer, pw0.i + {(_L - 1) / 2} - c.c AS x FROM pw0, (VALUES {rows}) AS c(i, c)))"


def _weighted_query(kind: str) -> None:
    @_add(f"wgkm_{kind}", f"SELECT q_id, r_id, k FROM ({_kernel_sql('pw', 'pw', mismatch_weights(_L, _K, _D), use_rc=True, by='center_idx', same=True, value=_ROUNDED, head=_weighted_cte(kind, [11.5]))})")
    def run(spark, sf_dir):
        return _rounded(WGKMKernel(_L, _K, _D, use_rc=True, weight_kernel=kind, weight_gamma=0.1, weight_sigma=8).set_references(_chunks(spark, sf_dir)).kernel())


for _kind in _POSITION_SQL:
    _weighted_query(_kind)


@_add("wgkm_cross", f"SELECT q_id, r_id, k FROM ({_kernel_sql('qw', 'pw', mismatch_weights(_L, _K, _D), use_rc=True, by='center_idx', same=True, value=_ROUNDED, head=_weighted_cte('gaussian', [11.5]) + ', qw AS (SELECT * FROM pw WHERE (seq_id // 1000) % 100 = 0)')})")
def wgkm_cross(spark, sf_dir):
    """Pieces of items whose id is divisible by 100 against all pieces."""
    chunks = _chunks(spark, sf_dir)
    kernel = WGKMKernel(_L, _K, _D, use_rc=True, weight_kernel="gaussian", weight_sigma=8).set_references(chunks)
    return _rounded(kernel.kernel(X_query=chunks.where(F.floor(F.col("seq_id") / 1000) % 100 == 0)))


@_add("wgkm_offsets", _kernel_sql("pw", "pw", mismatch_weights(_L, _K, _D), use_rc=True, by="center_idx", same=True, value=_ROUNDED, head=_weighted_cte("gaussian", [7.5, 11.5, 16.5])))
def wgkm_offsets(spark, sf_dir):
    kernel = WGKMKernel(_L, _K, _D, use_rc=True, weight_kernel="gaussian", weight_sigma=8)
    return _rounded(kernel.set_references(_chunks(spark, sf_dir)).kernel(offsets=[-4, 0, 5]))


@_add(
    "wgkm_windowed",
    _kernel_sql("cw", "cw", mismatch_weights(_L, _K, _D), use_rc=True, by="window_idx", same=True, value=_ROUNDED, head=f"{_CHUNKS}, {_window_cte('cw', 'chunks', 12, 4, 0, 0, pw='exp(-power(i + 2.5 - (window_idx * 4 + 5.5), 2) / 128.0)::DOUBLE')}"),
)
def wgkm_windowed(spark, sf_dir):
    kernel = WindowedWGKMKernel(_L, _K, _D, window=12, shift=4, use_rc=True, weight_kernel="gaussian", weight_sigma=8)
    return _rounded(kernel.set_references(_chunks(spark, sf_dir)).kernel())


# --- distances --------------------------------------------------------------


@_add("hamming_pairs", f"WITH {_CHUNKS} SELECT a.seq_id AS a_id, b.seq_id AS b_id, hamming(a.seq, b.seq)::DOUBLE AS d FROM chunks a JOIN chunks b ON a.seq_id < b.seq_id")
def hamming_pairs(spark, sf_dir):
    return Hamming().pdist(_chunks(spark, sf_dir))


@_add("levenshtein_pairs", f"WITH {_ITEMS} SELECT a.seq_id AS a_id, b.seq_id AS b_id, levenshtein(a.seq, b.seq)::DOUBLE AS d FROM items a JOIN items b ON a.seq_id < b.seq_id")
def levenshtein_pairs(spark, sf_dir):
    return Levenshtein().pdist(benchmark_sequences(spark, sf_dir))


@_add("levenshtein_cdist", f"WITH {_DOCS}, {_ITEMS} SELECT a.seq_id AS a_id, b.seq_id AS b_id, levenshtein(a.seq, b.seq)::DOUBLE AS d FROM docs a, items b")
def levenshtein_cdist(spark, sf_dir):
    return Levenshtein().cdist(_spread(document_sequences(spark, sf_dir)), benchmark_sequences(spark, sf_dir))


def _align_sql(match: float, mismatch: float, gap: float, local: bool, value: str = "s") -> str:
    """Rows of the alignment table as folds over lists; every list holds doubles, letters as their codes."""
    floor = (lambda x: f"greatest({x}, 0)") if local else (lambda x: x)
    first = f"list_transform(range(0, length(b) + 1), lambda j: {'0' if local else f'j * {gap}'}::DOUBLE)"
    steps = f"list_transform(range(1, len(ys) + 1), lambda j: [{floor(f'greatest(acc[j] + CASE WHEN c[1] = ys[j] THEN {match} ELSE {mismatch} END, acc[j + 1] + {gap})')}::DOUBLE])"
    start = "[0::DOUBLE]" if local else f"[acc[1] + {gap}]"
    body = f"list_reduce(list_concat([{start}], {steps}), lambda row, x: list_append(row, greatest(x[1], row[len(row)] + {gap})))"
    letters = lambda s: f"list_transform(string_split({s}, ''), lambda c: ascii(c)::DOUBLE)"
    if local:
        # The best cell so far is carried in front of each row.
        row = body.replace("acc[", "acc[1 + ").replace("acc[1 + j + 1]", "acc[j + 2]").replace("acc[1 + j]", "acc[j + 1]")
        fold = f"list_reduce(list_concat([list_concat([0::DOUBLE], {first})], list_transform(xs, lambda c: [c])), lambda acc, c: list_concat([greatest(acc[1], list_max({row}))], {row}))"
        score = f"({fold})[1]"
    else:
        fold = f"list_reduce(list_concat([{first}], list_transform(xs, lambda c: [c])), lambda acc, c: {body})"
        score = f"({fold})[length(b) + 1]"
    return f"""WITH {_ITEMS}, p AS (SELECT x.seq_id AS a_id, y.seq_id AS b_id, x.seq AS a, y.seq AS b, {letters('x.seq')} AS xs, {letters('y.seq')} AS ys FROM items x JOIN items y ON x.seq_id < y.seq_id)
    SELECT a_id, b_id, {value} AS d FROM (SELECT *, {score} AS s FROM p)"""


def _align_query(name: str, make: Callable, sql: str | None) -> None:
    @_add(name, sql)
    def run(spark, sf_dir):
        return make().pdist(benchmark_sequences(spark, sf_dir))


_align_query("nw_pairs", NeedlemanWunsch, _align_sql(1, -1, -1, False))
_align_query("sw_pairs", SmithWaterman, _align_sql(1, -1, -1, True))
_align_query("nw_nuc44_pairs", lambda: NeedlemanWunsch(gap=-4, substitution_matrix="NUC4.4"), _align_sql(5, -4, -4, False))
_align_query("nw_as_distance_pairs", lambda: NeedlemanWunsch(as_distance=True), _align_sql(1, -1, -1, False, "greatest(length(a), length(b)) - s"))

_DISTANCE_SQL = {"linear": "-d", "rbf": "exp(-0.01 * d * d)", "poly": "power(0.5 - 0.01 * d, 3)", "sigmoid": "tanh(0.5 - 0.01 * d)", "laplacian": "exp(-0.01 * d)", "exponential": "exp(-0.01 * d)", "exponential_clipped": "exp(-0.01 * greatest(0, d - 2))", "cauchy": "1 / (1 + 0.01 * d * d)"}


@_add("distance_kernels", f"SELECT a_id, b_id, {', '.join(f'round({x}, 6) + 0.0 AS k_{n}' for n, x in _DISTANCE_SQL.items())} FROM ({_SQL['levenshtein_pairs']})")
def distance_kernels(spark, sf_dir):
    pairs = Levenshtein().pdist(benchmark_sequences(spark, sf_dir))
    kernels = {t: DistanceKernel(Levenshtein(), t, gamma=0.01, coef0=0.5, degree=3, radius=2) for t in KERNEL_TRANSFORMS}
    return _rounded(pairs.select("a_id", "b_id", *[k.apply(F.col("d")).alias(f"k_{t}") for t, k in kernels.items()]), *[f"k_{t}" for t in kernels])


# --- neighbours and estimators ----------------------------------------------


def _searches(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("seq_id") % 100 == 0)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    return document_sequences(spark, sf_dir).join(marks, "seq_id")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to the tasks, for work that is heavy for each row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


_NEAR = f"""WITH {_DOCS}, t AS (SELECT seq_id, seq, quality AS label FROM docs JOIN labels ON doc_id = seq_id),
 n AS (SELECT q.seq_id AS q_id, t.label, row_number() OVER (PARTITION BY q.seq_id ORDER BY levenshtein(q.seq, t.seq), t.seq_id) AS r FROM docs q, t WHERE q.seq_id % 100 = 0),
 v AS (SELECT q_id AS seq_id, label, count(*) AS n FROM n WHERE r <= 5 GROUP BY ALL)"""


@_add(
    "knn_distance_weights",
    f"""{_NEAR.replace("SELECT q.seq_id AS q_id, t.label,", "SELECT q.seq_id AS q_id, t.label, levenshtein(q.seq, t.seq)::DOUBLE AS d,")},
 e AS (SELECT q_id AS seq_id, label, CASE WHEN min(d) OVER (PARTITION BY q_id) > 0 THEN 1 / d WHEN d = 0 THEN 1 ELSE 0 END AS v FROM n WHERE r <= 5)
 SELECT seq_id, label, round(sum(v) / sum(sum(v)) OVER (PARTITION BY seq_id), 6) + 0.0 AS proba FROM e GROUP BY seq_id, label""",
)
def knn_distance_weights(spark, sf_dir):
    return _rounded(KNNClassifier(Levenshtein(), 5, weights="distance").fit(_spread(_labelled(spark, sf_dir))).predict_proba(_searches(document_sequences(spark, sf_dir))), "proba")


@_add("knn_levenshtein", f"{_NEAR.replace(' WHERE q.seq_id % 100 = 0', '')} SELECT seq_id, arg_min(label, [-n, label]) AS predicted FROM v GROUP BY ALL")
def knn_levenshtein(spark, sf_dir):
    """All documents against all labelled ones."""
    return KNNClassifier(Levenshtein(), 5).fit(_spread(_labelled(spark, sf_dir))).predict(document_sequences(spark, sf_dir))


@_add("knn_proba", f"{_NEAR} SELECT seq_id, label, round(n / 5.0, 6) AS proba FROM v")
def knn_proba(spark, sf_dir):
    return _rounded(KNNClassifier(Levenshtein(), 5).fit(_spread(_labelled(spark, sf_dir))).predict_proba(_searches(document_sequences(spark, sf_dir))), "proba")


def _topk_sql(distance: str) -> str:
    return f"""WITH {_DOCS}, d AS (SELECT a.seq_id AS q_id, b.seq_id AS r_id, ({distance})::DOUBLE AS d FROM docs a, docs b WHERE a.seq_id % 100 = 0)
    SELECT * FROM (SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY d, r_id))::INT AS rank, r_id, d FROM d) WHERE rank <= 10"""


def _topk_query(name: str, metric: str, sql: str | None) -> None:
    @_add(name, sql)
    def run(spark, sf_dir):
        docs = document_sequences(spark, sf_dir)
        return ANNIndex(_spread(docs), metric).query(_searches(docs), 10)


_topk_query("ann_topk_levenshtein", "levenshtein", _topk_sql("levenshtein(a.seq, b.seq)"))
_topk_query("ann_topk_hamming", "hamming", _topk_sql("CASE WHEN length(a.seq) = length(b.seq) THEN CASE WHEN length(a.seq) > 0 THEN hamming(a.seq, b.seq) ELSE 0 END ELSE greatest(length(a.seq), length(b.seq)) END"))


def _aligned(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    docs = document_sequences(spark, sf_dir)
    return ANNIndex(_spread(docs), metric).query(_spread(_searches(docs)), 10)


@_add("ann_topk_nw")
def ann_topk_nw(spark, sf_dir):
    """Documents nearest to each searched document, all documents looked at."""
    return _aligned(spark, sf_dir, "nw")


@_add("ann_topk_sw")
def ann_topk_sw(spark, sf_dir):
    return _aligned(spark, sf_dir, "sw")


@_add(
    "ann_topk_gkm",
    f"""WITH dk AS ({_kernel_sql('dw', 'sw', mismatch_weights(_L, _K, _D, 'truncated'), use_rc=True, head=f"{_DOC_WINDOWS}, sw AS (SELECT * FROM dw WHERE seq_id % 100 = 0)")})
    SELECT * FROM (SELECT r_id AS q_id, (row_number() OVER (PARTITION BY r_id ORDER BY round(1 - k, 6) + 0.0, q_id))::INT AS rank, q_id AS r_id, round(1 - k, 6) + 0.0 AS d FROM dk) WHERE rank <= 10""",
)
def ann_topk_gkm(spark, sf_dir):
    docs = _long(document_sequences(spark, sf_dir))
    index = ANNIndex(_spread(docs), "gkm", gkm_L=_L, gkm_k=_K, gkm_d=_D, gkm_use_rc=True)
    index.distances = lambda queries, k=None, plain=index.distances: _rounded(plain(queries, k), "d")
    return index.query(_searches(docs), 10)


_SCORES = f"""WITH {_DOCS}, {_windows('w', 'docs', 4)}, c AS (SELECT quality AS y, kmer, count(*) AS n FROM w JOIN labels ON doc_id = seq_id GROUP BY ALL),
 a AS (SELECT unnest(['A','C','G','T']) AS c), f AS (SELECT a.c || b.c || d.c || e.c AS kmer FROM a, a AS b, a AS d, a AS e),
 s AS (SELECT kmer, coalesce((SELECT n FROM c WHERE c.kmer = f.kmer AND y = 1), 0) + 1 AS p, coalesce((SELECT n FROM c WHERE c.kmer = f.kmer AND y = 0), 0) + 1 AS q FROM f),
 sc AS (SELECT kmer, ln(p / sum(p) OVER ()) - ln(q / sum(q) OVER ()) AS score FROM s)"""


def _scorer(spark: SparkSession, sf_dir: str) -> DifferentialKmerScorer:
    rows = _labelled(spark, sf_dir)
    return DifferentialKmerScorer(SpectrumEncoder(4)).fit(rows.where("label = 1"), rows.where("label = 0"))


@_add("differential_scores", f"{_SCORES} SELECT kmer AS feature, round(score, 6) + 0.0 AS score FROM sc")
def differential_scores(spark, sf_dir):
    return _rounded(_scorer(spark, sf_dir).kmer_scores_.select("feature", "score"), "score")


@_add("differential_top20", f"{_SCORES} SELECT kmer AS feature, round(score, 6) + 0.0 AS score FROM sc ORDER BY sc.score DESC, kmer LIMIT 20")
def differential_top20(spark, sf_dir):
    return _rounded(_scorer(spark, sf_dir).top(20).select("feature", "score"), "score")


_DECISION = f"{_SCORES}, dd AS (SELECT seq_id, coalesce(sum(score), 0) AS x FROM docs LEFT JOIN w USING (seq_id) LEFT JOIN sc USING (kmer) GROUP BY seq_id)"


@_add("differential_decision", f"{_DECISION} SELECT seq_id, round(x, 5) + 0.0 AS decision FROM dd")
def differential_decision(spark, sf_dir):
    return _scorer(spark, sf_dir).decision_function(document_sequences(spark, sf_dir)).select("seq_id", (F.round("decision", 5) + F.lit(0.0)).alias("decision"))


@_add(
    "differential_auc",
    f"""{_DECISION}, j AS (SELECT round(x, 5) + 0.0 AS x, quality AS y FROM dd JOIN labels ON doc_id = seq_id WHERE quality IN (0, 1)),
 g AS (SELECT x, sum(CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS n FROM j GROUP BY x),
 b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
 SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b""",
)
def differential_auc(spark, sf_dir):
    """How well the decisions order the labelled documents."""
    marks = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    return _rounded(analysis.auc(differential_decision(spark, sf_dir).join(marks, "seq_id")), "auc")


@_add("differential_proba", f"{_DECISION} SELECT seq_id, round(1 / (1 + exp(-x)), 5) + 0.0 AS proba FROM dd")
def differential_proba(spark, sf_dir):
    return _scorer(spark, sf_dir).predict_proba(document_sequences(spark, sf_dir)).select("seq_id", (F.round("proba", 5) + F.lit(0.0)).alias("proba"))


def _gc_labelled(spark, sf_dir) -> DataFrame:
    """Items with label 1 if their share of G and C is above the median."""
    items = _long(benchmark_sequences(spark, sf_dir))
    rows = items.withColumn("gc", F.length(F.regexp_replace("seq", "[AT]", "")) / F.length("seq"))
    middle = rows.agg(F.expr("percentile(gc, 0.5)").alias("middle"))  # one row
    return rows.crossJoin(F.broadcast(middle)).select("seq_id", "seq", (F.col("gc") > F.col("middle")).cast("int").alias("label"))


@_add("kernel_svm_predict")
def kernel_svm_predict(spark, sf_dir):
    """Learned from the items with an even id, predicted for the others."""
    rows = _gc_labelled(spark, sf_dir)
    return KernelSVM(GKMKernel(_L, _K, _D, use_rc=True), C=10.0).fit(rows.where("seq_id % 2 = 0")).predict(rows.where("seq_id % 2 <> 0").select("seq_id", "seq"))


@_add("kernel_grid_auc")
def kernel_grid_auc(spark, sf_dir):
    """Schemes and transforms, learned from the even ids and judged on the others."""
    rows = _gc_labelled(spark, sf_dir)
    grid = [(f"{scheme}/{change}", GKMKernel(_L, _K, _D, kernel_type=scheme, use_rc=True, transform=change, transform_gamma=2.0, transform_coef0=1.0, transform_degree=2)) for scheme in ("full", "truncated") for change in ("linear", "rbf")]
    return analysis.kernel_grid(rows.where("seq_id % 2 = 0"), rows.where("seq_id % 2 <> 0"), grid)


@_add("kernel_linkage")
def kernel_linkage(spark, sf_dir):
    """The average-linkage tree of all items by kernel distance."""
    kernel = GKMKernel(_L, _K, _D, kernel_type="truncated", use_rc=True).set_references(_long(benchmark_sequences(spark, sf_dir))).kernel()
    merges = analysis.average_linkage(analysis.kernel_distances(kernel))
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step int, a int, b int, height double, size int")


@_add("differential_stringency")
def differential_stringency(spark, sf_dir):
    """Enriched k-mers of the items against backgrounds that keep counts of longer and longer words."""
    items = benchmark_sequences(spark, sf_dir)
    return analysis.stringency(items, lambda k: DifferentialKmerScorer(SpectrumEncoder(4, canonical_rc=True), background=KmerShuffler(k, seed=42)), range(1, 5))


@_add("linear_svm_predict")
def linear_svm_predict(spark, sf_dir):
    return LinearSVM(SpectrumEncoder(3), standardize=True, max_iter=30).fit(_labelled(spark, sf_dir)).predict(document_sequences(spark, sf_dir))


# --- background models ------------------------------------------------------


def _same_counts(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(seq_id, same): whether the k-mer counts of two versions agree."""

    def bag(df: DataFrame) -> DataFrame:
        kmers = F.when(F.length("seq") >= k, sq.col_kmers(F.col("seq"), k)).otherwise(F.array().cast("array<string>"))
        return df.select("seq_id", F.sort_array(kmers).alias("bag"), F.length("seq").alias("n"))

    left, right = bag(before), bag(after).select("seq_id", F.col("bag").alias("other"), F.col("n").alias("m"))
    return left.join(right, "seq_id").select("seq_id", ((F.col("bag") == F.col("other")) & (F.col("n") == F.col("m"))).alias("same"))


def _shuffle_query(name: str, make: Callable, k: int) -> None:
    @_add(name, "SELECT doc_id AS seq_id, true AS same FROM documents")
    def run(spark, sf_dir):
        docs = document_sequences(spark, sf_dir)
        return _same_counts(docs, make().perturb_many(_spread(docs)), k)


_shuffle_query("shuffle_preserve_counts", lambda: KmerShuffler(3, seed=5, endpoints="preserve"), 3)
_shuffle_query("shuffle_free_counts", lambda: KmerShuffler(2, seed=5), 2)
_shuffle_query("chunker_random_letters", lambda: Chunker(5, 20, seed=5), 1)
_shuffle_query("chunker_backtrack_letters", lambda: Chunker(5, 20, algorithm="backtrack", residual_chunk="end", seed=5), 1)


@_add("shuffle_crop_lengths", f"WITH {_DOCS} SELECT seq_id, (CASE WHEN length(seq) < 5 THEN length(seq) WHEN length(seq) - 4 < 3 THEN 0 ELSE length(seq) - 4 END)::BIGINT AS n FROM docs")
def shuffle_crop_lengths(spark, sf_dir):
    shuffled = KmerShuffler(3, seed=5, endpoints="crop").perturb_many(_spread(document_sequences(spark, sf_dir)))
    return shuffled.select("seq_id", F.length("seq").cast("long").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
