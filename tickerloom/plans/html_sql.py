"""SQL twin of the visible text of pages: pieces are walked one by one in a recursive query, references are decoded by a join."""

from __future__ import annotations

from html.entities import html5

from tickerloom.functions.html import CELL_ELEMENTS, HIDDEN_ELEMENTS, HIDDEN_STYLES, LINE_ELEMENTS, VOID


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _entity_rows() -> str:
    return ", ".join(f"({_text(name)}, {_text(value)})" for name, value in html5.items())


_WINDOWS = ", ".join(f"({n}, {_text(bytes([n]).decode('cp1252'))})" for n in range(128, 160) if n not in (129, 141, 143, 144, 157))

PAGE_TEXT = rf"""
WITH RECURSIVE entity(name, value) AS (VALUES {_entity_rows()}), windows(code, value) AS (VALUES {_WINDOWS}),
cut AS (
  SELECT page_id, html, unnest(regexp_extract_all(html, '(?i)<script\b[^>]*>[\s\S]*?(?:</script\s*>|\z)|<style\b[^>]*>[\s\S]*?(?:</style\s*>|\z)|<!--[\s\S]*?(?:-->|\z)|<[!?][^>]*>?|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+|<')) AS p,
    generate_subscripts(regexp_extract_all(html, '(?i)<script\b[^>]*>[\s\S]*?(?:</script\s*>|\z)|<style\b[^>]*>[\s\S]*?(?:</style\s*>|\z)|<!--[\s\S]*?(?:-->|\z)|<[!?][^>]*>?|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+|<'), 1) AS i
  FROM pages WHERE regexp_matches(html, '<|&[A-Za-z#]')
), tagged AS (
  SELECT page_id, i, p, CASE WHEN regexp_matches(p, '(?i)^<([!?]|(script|style)\b)') THEN 'silent' WHEN NOT regexp_matches(p, '^</?[A-Za-z]') THEN 'text' WHEN p[2] = '/' THEN 'close'
      WHEN lower(regexp_extract(p, '^</?([A-Za-z][^\s/>]*)', 1)) IN {_listed(VOID)} OR p LIKE '%/>' THEN 'single' ELSE 'open' END AS kind,
    lower(regexp_extract(p, '^</?([A-Za-z][^\s/>]*)', 1)) AS tag,
    regexp_replace(regexp_replace(regexp_extract(p, '(?i)[\s"'']style\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '^["'']|["'']$', '', 'g'), '/\*[\s\S]*?\*/', '', 'g') AS style
  FROM cut
), marked AS (
  SELECT page_id, i, p, kind, tag, tag IN {_listed(HIDDEN_ELEMENTS)} OR regexp_matches(regexp_replace(p, '"[^"]*"|''[^'']*''', '""', 'g'), '(?i)[\s"]hidden[\s=/>]') OR regexp_matches(style, '(?i){HIDDEN_STYLES}') AS hides,
    CASE WHEN tag IN {_listed(LINE_ELEMENTS)} THEN chr(10) WHEN tag IN {_listed(CELL_ELEMENTS)} THEN ' ' ELSE '' END AS gap
  FROM tagged
), parts AS (
  SELECT page_id, i, unnest(string_split(p, '&')) AS part, generate_subscripts(string_split(p, '&'), 1) AS k FROM marked WHERE kind = 'text'
), read AS (
  SELECT *, regexp_extract(part, '^(#[0-9]+|#[xX][0-9A-Fa-f]+);?', 0) AS num, regexp_extract(part, '^[A-Za-z][A-Za-z0-9]*;?') AS word FROM parts
), found AS (
  SELECT page_id, i, k, arg_max(e.value, length(e.name)) AS value, max(length(e.name)) AS size
  FROM read JOIN entity e ON k > 1 AND left(word, 2) = left(e.name, 2) AND starts_with(word, e.name) AND (NOT ends_with(e.name, ';') OR word = e.name) GROUP BY ALL
), coded AS (
  SELECT page_id, i, k, CASE WHEN num ILIKE '#x%' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(left(ltrim(rtrim(num[3:], ';'), '0'), 8), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('0123456789abcdef', lower(c)) - 1 END)), lambda a, b: a * 16 + b)
    ELSE coalesce(try_cast(left(ltrim(rtrim(num[2:], ';'), '0'), 9) AS BIGINT), 0) END AS code FROM read WHERE k > 1 AND num <> ''
), solved AS (
  SELECT r.page_id, r.i, r.k, CASE WHEN r.k = 1 THEN r.part
    WHEN r.num <> '' THEN CASE WHEN c.code = 0 OR c.code BETWEEN 55296 AND 57343 OR c.code > 1114111 THEN chr(65533) WHEN w.value IS NOT NULL THEN w.value WHEN c.code BETWEEN 128 AND 159 THEN chr(c.code::INT)
      WHEN c.code BETWEEN 1 AND 8 OR c.code = 11 OR c.code BETWEEN 14 AND 31 OR c.code = 127 OR c.code BETWEEN 64976 AND 65007 OR c.code % 65536 >= 65534 THEN '' ELSE chr(c.code::INT) END || substr(r.part, length(r.num) + 1)
    WHEN f.value IS NOT NULL THEN f.value || substr(r.part, f.size + 1) ELSE '&' || r.part END AS part
  FROM read r LEFT JOIN found f USING (page_id, i, k) LEFT JOIN coded c USING (page_id, i, k) LEFT JOIN windows w ON w.code = c.code
), texts AS (SELECT page_id, i, string_agg(part, '' ORDER BY k) AS said FROM solved GROUP BY ALL),
steps AS (SELECT m.*, said FROM marked m LEFT JOIN texts USING (page_id, i)),
walk(page_id, i, tags, hid, shown) AS (
  SELECT page_id, 0::BIGINT, []::VARCHAR[], []::BOOLEAN[], ''::VARCHAR FROM pages WHERE regexp_matches(html, '<|&[A-Za-z#]')
  UNION ALL
  SELECT page_id, i, CASE WHEN kind = 'open' THEN list_append(tags, tag) WHEN kind = 'close' AND spot > 0 THEN tags[:spot - 1] ELSE tags END,
    CASE WHEN kind = 'open' THEN list_append(hid, inn OR hides) WHEN kind = 'close' AND spot > 0 THEN hid[:spot - 1] ELSE hid END,
    shown || CASE WHEN kind = 'text' AND NOT inn THEN said WHEN kind = 'close' AND spot > 0 AND NOT hid[spot] THEN gap WHEN kind IN ('open', 'single') AND NOT (inn OR hides) THEN gap ELSE '' END
  FROM (SELECT s.*, w.tags, w.hid, w.shown, coalesce(w.hid[-1], false) AS inn, CASE WHEN list_contains(w.tags, s.tag) THEN len(w.tags) + 1 - list_position(list_reverse(w.tags), s.tag) ELSE 0 END AS spot
    FROM walk w JOIN steps s ON s.page_id = w.page_id AND s.i = w.i + 1)
), last AS (SELECT page_id, arg_max(shown, i) AS shown FROM walk GROUP BY page_id),
lines AS (
  SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(shown, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda l: trim(regexp_replace(l, '[\s\x0b\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM last
)
SELECT p.page_id, length(coalesce(l.text, p.html))::INT AS chars, sha256(coalesce(l.text, p.html)) AS text_hash FROM pages p LEFT JOIN lines l USING (page_id)
"""
