"""The queries of this subpackage, their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, lm, minhash, mixing, pii, quality, rules, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op2_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.quality_model(docs, _table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.removed(_table(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op9_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.toxicity_model(docs, _table(spark, sf_dir, "labels")))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.checked(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_gated_language_model, op3_quality_classifier, op4_decontamination, op5_arc_to_warc, op6_quality_rules, op7_repeated_passages, op8_source_mixing, op9_toxicity_trees, op10_pii_surrogates)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {}

SQL["op6_quality_rules"] = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, coalesce(wc, 0) AS word_chars, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS r1,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS r2,
             CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS r3,
             CASE WHEN n_words > 0 THEN 1000 * coalesce(wc, 0) // n_words ELSE 0 END AS r4 FROM m),
x AS (SELECT lang, source, u.rate AS rate, u.least_spread AS ls, u.v AS v FROM
      (SELECT lang, source, unnest([{'rate': 1, 'least_spread': 50, 'v': r1}, {'rate': 2, 'least_spread': 100, 'v': r2},
                                    {'rate': 3, 'least_spread': 70, 'v': r3}, {'rate': 4, 'least_spread': 2000, 'v': r4}]) AS u FROM r WHERE NOT base_failed)),
b AS (SELECT lang, source, rate, ls, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::BIGINT) << (length(bin(v)) - 6)::BIGINT END AS bin FROM x),
q AS (SELECT lang, source, rate, any_value(ls) AS ls, count(*) AS n, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM b GROUP BY ALL),
qa AS (SELECT rate, any_value(ls) AS ls, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM b GROUP BY ALL),
f AS (SELECT q.lang, q.source, q.rate, CASE WHEN q.n >= 30 THEN q.q75 + 3 * greatest(q.q75 - q.q25, q.ls) ELSE qa.q75 + 3 * greatest(qa.q75 - qa.q25, qa.ls) END AS fence
      FROM q JOIN qa USING (rate)),
g AS (SELECT lang, source, max(fence) FILTER (rate = 1) AS f1, max(fence) FILTER (rate = 2) AS f2, max(fence) FILTER (rate = 3) AS f3, max(fence) FILTER (rate = 4) AS f4 FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(r1 > f1 OR r2 > f2 OR r3 > f3 OR r4 > f4, false)) AS kept
FROM r LEFT JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
"""

SQL["op8_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS bin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
      FROM o WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, struct_pack(a := cap / weight, b := -level)) FROM l WHERE cap >= level * weight) * weight, cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS whole FROM t),
e AS (SELECT source, bin + 1 AS cut, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS below FROM d GROUP BY source, bin
      UNION ALL SELECT source, 0, 0 FROM s),
st AS (SELECT source, start, coalesce(sum(size) FILTER (bin < start), 0) AS front FROM d, (SELECT unnest(range(0, 65536, 2048))::INT AS start) GROUP BY source, start),
c AS (SELECT g.source, g.source_size, g.target, g.whole, arg_min(struct_pack(a := st.start, z := e.cut), struct_pack(a := abs(e.below - st.front - (g.target - g.whole * g.source_size)), b := st.start, c := e.cut)) AS best
      FROM g JOIN e ON e.source IS NOT DISTINCT FROM g.source JOIN st ON st.source IS NOT DISTINCT FROM g.source AND e.cut >= st.start GROUP BY ALL)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN bin >= best.a AND bin < best.z THEN 1 ELSE 0 END)::BIGINT AS taken, whole + CASE WHEN bin >= best.a AND bin < best.z THEN 1 ELSE 0 END AS copies
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

SQL["op4_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bn AS (SELECT item_id, i, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT n FROM bn),
dn AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT dn.doc_id, dn.i AS p, dn.n, bn.item_id, bn.i AS q FROM dn JOIN bn ON dn.n = bn.n AND dn.k = bn.k),
hx AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS x FROM m),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM hx GROUP BY doc_id),
sp AS (SELECT doc_id, string_agg((a - 1) || '-' || z, ',' ORDER BY a) AS hit_spans FROM (SELECT doc_id, min(x) AS a, max(x) AS z
        FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS g FROM hx) GROUP BY doc_id, g) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, item_id, p, q, n FROM m),
lm AS (SELECT doc_id, max(len) AS longest FROM (SELECT doc_id, item_id, d, grp, count(*) - 1 + any_value(n) AS len
        FROM (SELECT doc_id, item_id, n, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS grp FROM g) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match, coalesce(hit_spans, '') AS hit_spans
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN sp USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lm USING (doc_id)
"""

SQL["op5_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM m
"""
