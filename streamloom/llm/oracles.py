"""DuckDB SQL with the results of the queries that SQL can express."""

op1_url_filter = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(r_host, r_path, rule, verdict) AS (
  VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
         ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
  FROM split LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

op4_chat_format = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS kind,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + length(regexp_replace(text, '(</?s>|\[/?(?:SYS|INST|OUT|ROLE)\])', '\1#', 'g')) - length(text) AS escaped FROM rows),
sized AS (
  SELECT *, escaped + CASE kind WHEN 1 THEN 9 + 11 WHEN 2 THEN 10 + 12 WHEN 3 THEN 9 + 11 ELSE 10 + length(role) + 9 + 5 END AS chars,
    CASE kind WHEN 1 THEN before IS NULL WHEN 2 THEN before IS NULL OR before IN ('system', 'assistant') WHEN 3 THEN before IS NOT DISTINCT FROM 'user' ELSE false END AS fine
  FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (kind = 3), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (kind = 3), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fine) AS valid
FROM sized GROUP BY conv_id
"""
