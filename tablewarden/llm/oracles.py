"""SQL (DuckDB) for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark
), v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0
), d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), p AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS k, w FROM d CROSS JOIN (SELECT DISTINCT n FROM v) WHERE len(w) >= n
), h AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM p) p JOIN v USING (n, g)
), c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS place FROM h) GROUP BY doc_id
), f AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM d WHERE len(w) >= 5))
), r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + 4)) AS place FROM g WHERE n > 1) GROUP BY doc_id
), b AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
), h AS (
  SELECT host, count(*) AS n, CAST(count(*) FILTER (WHERE base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS DOUBLE) AS bad FROM f WHERE host IS NOT NULL GROUP BY host
), m AS (SELECT least(greatest(coalesce(avg(bad / n), 0.5), 0.001), 0.999) AS mean, coalesce(var_samp(bad / n), 0) AS var, coalesce(avg(1.0 / n), 0) AS chance FROM h
), q AS (SELECT mean, var - mean * (1 - mean) * chance AS var FROM m
), p AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1000) ELSE 1000 END AS strength FROM q
), t AS (SELECT *, round(least(greatest(mean + 3 * sqrt(mean * (1 - mean) / (strength + 1)), 2 * mean), 0.5), 6) AS cut FROM p
), v AS (SELECT host, cut, CAST(round((bad + mean * strength) / (n + strength), 9) AS DOUBLE) AS rate FROM h, t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= cut, TRUE) AS kept, rate AS host_rate FROM f LEFT JOIN v USING (host)
"""

_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _rule_cases(k: int) -> str:
    cases = []
    for rule in sorted(_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, start = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}') THEN '{rule[k]}'")
    return f"CASE {' '.join(cases)} END"


_LINK = """(?i)[\\x20\\t\\n\\f\\r]href[\\x20\\t\\n\\f\\r]*=[\\x20\\t\\n\\f\\r]*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\x20\\t\\n\\f\\r>]+)"""

URL_FILTERS = f"""
WITH RECURSIVE u AS (SELECT page_id, html, strpos(url, '://') AS cut, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), b AS (SELECT page_id, html, CASE WHEN cut > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host, CASE WHEN cut > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), j AS (SELECT page_id, html, host, path, {_rule_cases(1)} AS rule, {_rule_cases(0)} AS by_rule FROM b
), l AS (SELECT host AS src, translate(link, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{_LINK}', 1))) AS link FROM j WHERE host <> '')
), e AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM l WHERE src <> dst GROUP BY src, dst
), k AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE by_rule = 'allow') / count(*) AS trust, count(*) FILTER (WHERE by_rule = 'block') / count(*) AS distrust FROM j WHERE host <> '' GROUP BY host
), seed AS (SELECT 'trust' AS kind, host, trust AS weight FROM k WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM k WHERE distrust > 0
), step AS (
  SELECT 'trust' AS kind, src, dst, share, 0.0::DOUBLE AS jump FROM e UNION ALL SELECT 'distrust', dst, src, share, 0.0 FROM e UNION ALL SELECT kind, host, host, 0.0, weight FROM seed
), r AS (
  SELECT 0 AS i, kind, host, weight AS rank FROM seed
  UNION ALL SELECT r.i + 1, r.kind, step.dst, sum(0.85::DOUBLE * r.rank * step.share + step.jump) FROM r JOIN step ON step.kind = r.kind AND step.src = r.host WHERE r.i < 20 GROUP BY r.i + 1, r.kind, step.dst
), ranked AS (SELECT host, round(coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0), 12) AS trust, round(coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0), 12) AS distrust FROM r WHERE i = 20 GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM j LEFT JOIN ranked ON ranked.host = j.host
"""

ORACLE_SQL = {"op2_near_join": NEAR_JOIN, "op3_decontamination": DECONTAMINATION, "op6_url_filters": URL_FILTERS, "op7_quality_rules": QUALITY}
