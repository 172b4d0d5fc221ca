"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanguard.llm import bpe, html, language_model, lexical, mixing, near_dups, quality, sharding, suffixes, token_counts, topk, url_lists, whitening

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        topk.op1_top_k, quality.op2_quality_divergence, url_lists.op3_url_lists, suffixes.op4_suffix_dedup,
        language_model.op5_deleted_interpolation, html.op6_html_line_blocks, mixing.op7_pareto_mix, token_counts.op8_token_lengths,
        near_dups.op9_order_minhash, bpe.op10_prefix_bpe, lexical.op11_blocked_lexical, sharding.op12_rendezvous_shards,
        whitening.op13_incremental_whitening)
}

_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS a FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.a, c.a) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.a) = len(q.a)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

_OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '~') AS lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, len(w) AS n_words FROM d),
g AS (SELECT k, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM g) WHERE c > 1),
z AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY k),
l AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
c0 AS (
  SELECT k, length(t) AS l0, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS s0 FROM d),
c1 AS (SELECT *, regexp_replace(s0, '[a-z]+', '', 'g') AS s1 FROM c0),
c2 AS (SELECT *, regexp_replace(s1, '[A-Z]+', '', 'g') AS s2 FROM c1),
c3 AS (SELECT *, regexp_replace(s2, '[0-9]+', '', 'g') AS s3 FROM c2),
c4 AS (SELECT *, regexp_replace(s3, '[.,;:!?''"()-]+', '', 'g') AS s4 FROM c3),
c5 AS (SELECT *, regexp_replace(s4, '[#*$%&|<>]+', '', 'g') AS s5 FROM c4),
c6 AS (SELECT *, regexp_replace(s5, '[@^~=+/\\_{}\[\]`]+', '', 'g') AS s6 FROM c5),
c AS (
  SELECT k, length(s0) AS word_chars, length(s4) - length(s5) AS n_symbols,
    [l0 - length(s0), length(s0) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4),
     length(s4) - length(s5), length(s5) - length(s6), length(s6)] AS cls FROM c6),
f AS (SELECT lang, x, count(*) AS m FROM (SELECT lang, unnest(w) AS x FROM n WHERE n_words >= 50) GROUP BY ALL),
t AS (
  SELECT lang, list(x ORDER BY m DESC, x) AS common, list(m ORDER BY m DESC, x) AS counts
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, x) AS r FROM f) WHERE r <= 12 GROUP BY lang),
u AS (
  SELECT lang, sum(n_words) AS total, list(s ORDER BY i) AS sums FROM (
    SELECT lang, i, sum(cls[i]) AS s, sum(n_words) AS n_words FROM n JOIN c USING (k), range(1, 9) AS o(i) WHERE n_words >= 50 GROUP BY ALL) GROUP BY lang),
h AS (
  SELECT k, n.lang, n_words, total / 8 AS total, cls, sums, counts,
    list_transform(common, lambda y: len(list_filter(w, lambda x: x = y))) AS hits
  FROM n JOIN c USING (k) LEFT JOIN t ON t.lang = n.lang LEFT JOIN u ON u.lang = n.lang),
p AS (
  SELECT k, n_words, total, counts, sums,
    list_transform(cls, lambda x: x / greatest(list_sum(cls), 1)) AS p1, list_transform(sums, lambda x: x / list_sum(sums)) AS q1,
    list_transform(list_prepend(n_words - coalesce(list_sum(hits), 0), hits), lambda x: x / greatest(n_words, 1)) AS p2,
    list_transform(list_prepend(total - list_sum(counts), counts), lambda x: x / total) AS q2 FROM h),
j AS (
  SELECT k, n_words, total,
    sqrt(greatest(list_sum(list_transform(list_zip(p1, q1), lambda z: (
      CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2)), 0)) AS class_gap,
    sqrt(greatest(list_sum(list_transform(list_zip(p2, q2), lambda z: (
      CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2)), 0)) AS word_gap
  FROM p WHERE counts IS NOT NULL AND n_words > 0),
b AS (
  SELECT n.k, doc_id, CAST(n.n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM n JOIN c USING (k) LEFT JOIN z USING (k) LEFT JOIN l USING (k)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, e.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(total >= 1000 AND (class_gap > CASE WHEN e.n_words < 100 THEN 0.30 ELSE 0.25 END OR word_gap > 0.40), false) AS kept
FROM e LEFT JOIN j USING (k)"""

_OP7 = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
x AS (
  SELECT *, (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u,
    CAST(floor(sqrt(sqrt(size)) * 1000) AS BIGINT) AS g FROM r),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * g)::BIGINT AS mass,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM x GROUP BY source),
o AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS taken,
    sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
v AS (SELECT (wanted - taken) / open AS level FROM o WHERE (wanted - taken) / open * w <= 2 * source_size ORDER BY 2 * source_size / w LIMIT 1),
t AS (SELECT source, source_size, mass, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, v),
m AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (
  SELECT x.doc_id, x.source, x.size, x.u, m.source_size, target, whole, target - whole * source_size AS missing,
    least(greatest(CASE WHEN mass > 0 THEN (target - whole * source_size) * g / mass ELSE 0 END, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p
  FROM x JOIN m ON x.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN missing > 0 AND before + size / 2 < missing THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM c"""

_OP4 = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS i, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT k, i, h, unnest(range(0, strlen(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(i) AS first FROM w GROUP BY s),
g AS (SELECT k, p, p - lag(p) OVER (PARTITION BY k ORDER BY p) AS gap FROM w JOIN m USING (s) WHERE i > first),
n AS (SELECT k, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS run FROM g),
r AS (SELECT k, run, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY k, run),
x AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM r),
y AS (
  SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM x JOIN d USING (k) GROUP BY k)
SELECT doc_id, strlen(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN y USING (k)"""

SQL = {"op1_top_k": _OP1, "op2_quality_divergence": _OP2, "op3_url_lists": url_lists.OP3_SQL,
       "op4_suffix_dedup": _OP4, "op7_pareto_mix": _OP7, "op11_blocked_lexical": lexical.OP11_SQL, "op12_rendezvous_shards": sharding.OP12_SQL}
