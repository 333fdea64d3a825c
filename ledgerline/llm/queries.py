"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, decontaminate, exact_dedup, filter_audit, html_extract, jaccard_join, language_id, license_scan, merkle, packing, substring_dedup, toxicity, url_filter
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(spark, table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extraction_report(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_url_filter, op3_toxicity, op4_jaccard_join, op5_license_scan, op6_decontamination, op7_substring_dedup, op8_language_id, op9_html_extraction, op10_exact_dedup, op11_filter_audit, op12_best_fit_packing, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM h
), r(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT row_number() OVER () AS k, * FROM p
), best AS (
  SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM f JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f LEFT JOIN best USING (k)
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT k, array_to_string(w[i : i + 3], ' ') AS sh FROM d, unnest(generate_series(1, greatest(1, len(w) - 3))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT k, count(*) AS n FROM s GROUP BY k
), p AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.k < b.k GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(k, m) AS (
  SELECT k, k FROM d UNION SELECT r.k, e.b FROM r JOIN e ON r.m = e.a
), c AS (
  SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.m GROUP BY r.k
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (k) JOIN c USING (k)
""",
    "op6_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i)
  WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT n FROM p
), dw AS (
  SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM d, lens, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
  WHERE len(w) >= n
), occ AS (
  SELECT k, i, dw.n, item_id FROM dw JOIN p USING (n, phrase)
), hit AS (
  SELECT k, count(DISTINCT j) AS n_hit FROM occ, unnest(generate_series(i, i + n - 1)) AS t(j) GROUP BY k
), its AS (
  SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
""",
    "op7_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS phrase FROM d, unnest(generate_series(1, len(w) - 19)) AS t(i) WHERE len(w) >= 20
), again AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) > 1 AS rep FROM win
), gone AS (
  SELECT DISTINCT doc_id, i + j AS k FROM again, generate_series(0, 19) AS t(j) WHERE rep
), kept AS (
  SELECT d.doc_id, count(g.k) AS n_removed, coalesce(string_agg(w[k0], ' ' ORDER BY k0) FILTER (WHERE g.k IS NULL), '') AS txt
  FROM d, unnest(generate_series(1, len(w))) AS t(k0) LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.k = k0
  GROUP BY d.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
         min(doc_id) OVER (PARTITION BY t) AS least
  FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * capitals > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS fails
  FROM w LEFT JOIN l USING (doc_id)
), long AS (
  SELECT row_number() OVER () AS k, part, good, toxic,
         CAST(fails.A AS INT) + 2 * CAST(fails.B AS INT) + 4 * CAST(fails.C AS INT) + 8 * CAST(fails.D AS INT) + 16 * CAST(fails.E AS INT) AS mask
  FROM f
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM long GROUP BY part, mask
), letter(x, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.x || b.x || e.x || g.x || h.x AS filter_order, [a.bit, b.bit, e.bit, g.bit, h.bit] AS bits
  FROM letter a, letter b, letter e, letter g, letter h
  WHERE a.bit + b.bit + e.bit + g.bit + h.bit = 31 AND len(list_distinct([a.bit, b.bit, e.bit, g.bit, h.bit])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS before FROM o, unnest(generate_series(1, 5)) AS u(step)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (before + bit)::INT = 0) AS kept, sum(n) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS removed,
         sum(n) FILTER (mask & before::INT <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE enc AS (
  SELECT row_number() OVER () AS k, doc_id, source,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
         text, replace(text, chr(10), '') AS cut,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                     lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS crc_below
  FROM documents
), leaf AS (
  SELECT k, doc_id, source, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN coalesce((4294967295 - crc_below) % 2 = 0, false) THEN sha256(array_to_string(head, '') || coalesce(strlen(cut) || ':' || cut, '-')) END AS tampered
  FROM enc
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf
), up(l, source, pos, digest, n) AS (
  SELECT 0, source, pos, leaf, n FROM numbered
  UNION ALL
  SELECT l + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY l, source, pos // 3, n
), sub AS (
  SELECT source, digest, l AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top(l, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM sub
  UNION ALL
  SELECT l + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, pos // 3, n
), sib AS (
  SELECT l, coalesce('s' || source, 'n') AS tree, pos, list(digest) OVER w AS run, pos % 3 AS i FROM up WHERE n > 1 WINDOW w AS (PARTITION BY l, source, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), tsib AS (
  SELECT l, pos, list(digest) OVER w AS run, pos % 3 AS i FROM top WHERE n > 1 WINDOW w AS (PARTITION BY l, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), climb(k, tree, l, pos, node, proof) AS (
  SELECT k, coalesce('s' || source, 'n'), 0, pos, coalesce(tampered, leaf), '' FROM numbered
  UNION ALL
  SELECT c.k, c.tree, c.l + 1, c.pos // 3, sha256(array_to_string(run[1 : i], '') || c.node || array_to_string(run[i + 2 :], '')), c.proof || array_to_string(run[1 : i], '') || array_to_string(run[i + 2 :], '')
  FROM climb c JOIN sib s ON s.l = c.l AND s.tree = c.tree AND s.pos = c.pos
), atsub AS (
  SELECT c.k, c.node, c.proof, s.digest AS subroot, s.pos FROM climb c JOIN sub s ON c.tree = coalesce('s' || s.source, 'n') AND c.l = s.height
), climb2(k, l, pos, node, proof, subroot) AS (
  SELECT k, 0, pos, node, proof, subroot FROM atsub
  UNION ALL
  SELECT c.k, c.l + 1, c.pos // 3, sha256(array_to_string(run[1 : i], '') || c.node || array_to_string(run[i + 2 :], '')), c.proof || array_to_string(run[1 : i], '') || array_to_string(run[i + 2 :], ''), c.subroot
  FROM climb2 c JOIN tsib s ON s.l = c.l AND s.pos = c.pos
), root AS (
  SELECT l AS height, digest AS root FROM top WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climb2 JOIN root ON l = height JOIN numbered USING (k)
""",
}
