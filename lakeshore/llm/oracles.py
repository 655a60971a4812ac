"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from lakeshore.llm.url_filters import LOWER, SITE_RULES, SPAM_WORDS, UPPER

# ---------------------------------------------------------------- 11 URL filters


def _fits(site: str) -> str:
    host, slash, path = site.partition("/")
    return f"((host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{path}'))"


_longest_first = sorted(SITE_RULES, key=lambda r: (-len(r.name), r.name))

URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits(r.name)} THEN '{r.name}'" for r in _longest_first)} END AS rule,
         CASE {' '.join(f"WHEN {_fits(r.name)} THEN '{r.verdict}'" for r in _longest_first)}
              WHEN regexp_matches(host, '(^|[^A-Za-z0-9])({'|'.join(SPAM_WORDS)})($|[^A-Za-z0-9])') THEN 'block'
              ELSE 'allow' END AS verdict
  FROM parts)
SELECT page_id, host, path, rule, verdict FROM ruled
"""

# ---------------------------------------------------------------- 12 ranked search

_TERMS = (f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

RANKED_SEARCH = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
each_term AS (SELECT r, doc_id, n, unnest(terms) AS term FROM docs),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM each_term
       WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, totals GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * nn) // ll)))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# ---------------------------------------------------------------- 13 conversation repair
# a state of the dynamic program is one text: nine digits of cost, then the edits; least() is the cheapest, then ASCII-least


def _with(cell: str, cost: str, edit: str) -> str:
    return f"(printf('%09d', substr({cell}, 1, 9)::INTEGER + {cost}) || substr({cell}, 10) || '{edit}')"


_crc32 = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda b: ord(b)::BIGINT)), "
          "lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), "
          "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)")

DIALOG_REPAIR = f"""
WITH RECURSIVE
caused AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS cause
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN cause = 4 THEN 'user' ELSE role END AS role,
         CASE cause WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN cause = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM caused WHERE cause <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed),
keyed AS (
  SELECT *, fault IS NOT NULL AND fault <> 'truncated' AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM marked),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM keyed GROUP BY conv_id),
dp AS (
  SELECT conv_id, n, 0::BIGINT AS i, '000000000' AS c0, NULL::VARCHAR AS c1, '000000002I' AS c2, '000000004II' AS c3 FROM facts
  UNION ALL
  SELECT conv_id, n, i, m0, m1, m2, least(m3, {_with('m2', '2', 'I')}) FROM (
    SELECT conv_id, n, i, m0, m1, m3,
           least(t2, {_with('m0', '2', 'I')}, {_with('m1', '2', 'I')}, {_with('m3', '2', 'I')}) AS m2
    FROM (
      SELECT dp.conv_id, dp.n, k.i, {_with('c0', '3', 'D')} AS m0,
             least({_with('c1', '3', 'D')}, CASE WHEN NOT gone AND initial = 's' THEN {_with('c0', 'extra', 'K')} END) AS m1,
             least({_with('c2', '3', 'D')}, CASE WHEN NOT gone THEN {_with('least(c0, c1, c3)', 'extra + 2', 'R')} END,
                   CASE WHEN NOT gone AND initial = 'u' THEN {_with('least(c0, c1, c3)', 'extra', 'K')} END) AS t2,
             least({_with('c3', '3', 'D')}, CASE WHEN NOT gone THEN {_with('c2', 'extra + 2', 'R')} END,
                   CASE WHEN NOT gone AND initial = 'a' THEN {_with('c2', 'extra', 'K')} END) AS m3
      FROM dp JOIN keyed k ON k.conv_id IS NOT DISTINCT FROM dp.conv_id AND k.i = dp.i + 1))),
ended AS (
  SELECT conv_id, substr(least(c0, c3), 1, 9)::BIGINT AS cost, substr(least(c0, c3), 10) AS audit FROM dp WHERE i = n),
edits AS (
  SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS pos FROM ended),
stepped AS (
  SELECT conv_id, pos, audit[pos] AS edit, len(replace(left(audit, pos), 'I', '')) AS i,
         len(replace(left(audit, pos), 'D', '')) AS place FROM edits),
joined AS (
  SELECT s.conv_id, s.pos, s.edit, s.place, k.role, k.text,
         first_value(s.edit = 'K' AND k.initial = 's') OVER (PARTITION BY s.conv_id ORDER BY s.pos) AS system_first
  FROM stepped s LEFT JOIN keyed k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i AND s.edit <> 'I'
  WHERE s.edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(
           CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN system_first THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS sha
  FROM joined GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {"op11_url_filters": URL_FILTERS, "op12_norm_buckets": RANKED_SEARCH, "op13_dialog_repair": DIALOG_REPAIR}
