"""SQL of the rejected records, by list functions of DuckDB."""

from __future__ import annotations

from leadloom.plans.contacts import count

MISSING = "('', 'n/a', '-', 'none', 'null', 'unknown')"
ADDRESS = "[^@\\s<>,;]+@[^@\\s.<>,;]+(?:\\.[^@\\s.<>,;]+)+"


def _edge(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{200B}}\\x{{FEFF}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{200B}}\\x{{FEFF}}\\x{{3000}}]+$', '', 'g')"


REJECTS = f"""
WITH heads AS (SELECT file_name, max(regexp_extract(line, 'First Name"?([,;\\t|])"?Last Name', 1)) AS d FROM leads_sample_lines WHERE line_no = 1 GROUP BY file_name),
rec AS MATERIALIZED (SELECT line_id, coalesce(nullif(d, ''), ',') AS d, string_split(regexp_replace(line, '\\r?\\n$', ''), '"') AS seg FROM leads_sample_lines l LEFT JOIN heads h ON l.file_name = h.file_name
  WHERE coalesce(line_no, 0) <> 1 AND coalesce({_edge('line')}, '') <> ''),
shape AS MATERIALIZED (SELECT line_id, len(seg) % 2 = 1 AND len(list_filter(list_transform(seg, lambda s, i: CASE WHEN i % 2 = 0 OR len(seg) = 1 THEN TRUE WHEN i = 1 THEN s = '' OR ends_with(s, d)
    WHEN i = len(seg) THEN s = '' OR starts_with(s, d) ELSE s = '' OR (starts_with(s, d) AND ends_with(s, d)) END), lambda ok: NOT ok)) = 0 AS quoting_ok,
  string_split(array_to_string(list_transform(seg, lambda s, i: CASE WHEN i % 2 = 0 THEN s WHEN s = '' AND i > 1 AND i < len(seg) THEN '"' ELSE replace(s, d, chr(57344)) END), ''), chr(57344)) AS cells FROM rec),
good AS MATERIALIZED (SELECT line_id, {_edge('cells[10]')} AS employees, {_edge('cells[4]')} AS email, {_edge('cells[5]')} AS phone FROM shape WHERE quoting_ok AND len(cells) = 12)
SELECT DISTINCT line_id, reason FROM (
  SELECT line_id, CASE WHEN NOT quoting_ok THEN 'quoting' ELSE 'column_count' END AS reason FROM shape WHERE NOT quoting_ok OR len(cells) <> 12
  UNION ALL SELECT line_id, 'employees' FROM good WHERE lower(employees) NOT IN {MISSING} AND {count('employees')} IS NULL
  UNION ALL SELECT line_id, 'email' FROM good WHERE lower(email) NOT IN {MISSING} AND NOT regexp_full_match(email, '(?:(?:mailto:)?\\s*{ADDRESS}|[^<>@]*<\\s*(?:mailto:)?{ADDRESS}\\s*>)', 'i')
  UNION ALL SELECT line_id, 'phone' FROM good WHERE lower(phone) NOT IN {MISSING} AND (length(regexp_replace(phone, '[^0-9]', '', 'g')) < 7 OR regexp_matches(phone, '\\pL')))"""
