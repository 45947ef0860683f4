"""The operators' queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import compression, fim, fingerprint, jaccard, langid, packing, pii, quality, sp_sampling, toxicity, url_filter, warc, whitening
from tidebook.llm.common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda spark, d: pii.query(read(spark, d, "documents")),
        "op2_toxicity": lambda spark, d: toxicity.query(read(spark, d, "documents"), read(spark, d, "labels")),
        "op3_url_filter": lambda spark, d: url_filter.judge(read(spark, d, "pages")),
        "op4_warc": lambda spark, d: warc.query(read(spark, d, "pages")),
        "op5_packing": lambda spark, d: packing.query(read(spark, d, "documents")),
        "op6_quality": lambda spark, d: quality.judged(read(spark, d, "documents")),
        "quality_ablation": lambda spark, d: quality.ablations(read(spark, d, "documents")),
        "op7_langid": lambda spark, d: langid.query(read(spark, d, "documents")),
        "op8_fingerprint": lambda spark, d: fingerprint.query(read(spark, d, "documents")),
        "op9_jaccard": lambda spark, d: jaccard.query(read(spark, d, "documents")),
        "op10_sp_sampling": lambda spark, d: sp_sampling.query(read(spark, d, "documents")),
        "op11_fim": lambda spark, d: fim.query(read(spark, d, "documents")),
        "op12_whitening": lambda spark, d: whitening.query(read(spark, d, "embeddings")),
        "op13_compression": lambda spark, d: compression.query(read(spark, d, "documents"), read(spark, d, "labels")),
    }


_SPACE = r"[\x20\x09-\x0D]"

OP3 = r"""
WITH RECURSIVE base AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM base
), rules(action, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path,
    arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action,
    any_value(CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
      coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+)=')), '&'), ''), '') END) AS key
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
), hit AS (
  SELECT key FROM ruled WHERE key IS NOT NULL GROUP BY key HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hit.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN hit.key IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM ruled LEFT JOIN hit USING (key)
"""

OP4 = """
WITH base AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM base)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM last
"""

_LEDGER = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM counted, (VALUES (0), (1), (2)) o(d) WHERE k >= 2 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}\x{{25cf}}]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}}){_SPACE}*$'))) AS n_ellipsis_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS n_letters
  FROM t LEFT JOIN covered USING (doc_id)
), f AS (SELECT *, {" + ".join(f"CASE WHEN {fails} THEN {quality.BIT[name]} ELSE 0 END" for name, fails in quality.RULES.items())} AS bits FROM m)
"""
OP6 = rf"""{_LEDGER}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (bits & {quality.mask("base")}) <> 0 AS base_failed, (bits & {quality.mask("base") | quality.mask(quality.CURRENT)}) = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits,
  {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "n_upper", "n_letters"))}
FROM f
"""

ABLATION = _LEDGER + " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (bits & {quality.BIT[rule]} <> 0) AS n_failed, count(*) FILTER (bits & {quality.mask(policy)} = {quality.BIT[rule]}) AS n_failed_alone FROM f"
    for policy, rules in quality.POLICIES.items() for rule in rules
)

OP9 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 4)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(t.doc_id, min(reach.y)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN reach ON reach.x = t.doc_id GROUP BY t.doc_id
"""

OP11 = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS u1, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS u2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(l[1:least(u1, u2)], '') AS a, array_to_string(l[least(u1, u2) + 1:greatest(u1, u2)], '') AS m, array_to_string(l[greatest(u1, u2) + 1:], '') AS z FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """Oracles in SQL. op3's leaves out canonical links and redirects, of which the given pages have none; the
    others are tested against brute force, exact round trips or held-out accuracy."""
    return {"op3_url_filter": OP3, "op4_warc": OP4, "op6_quality": OP6, "quality_ablation": ABLATION, "op9_jaccard": OP9, "op11_fim": OP11}
