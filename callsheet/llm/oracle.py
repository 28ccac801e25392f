"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {}

ORACLE["op3_warc"] = """
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM payload
)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM grouped
"""

_CONTROL = r"<\||</?s>|<</?SYS>>|\[/?INST\]"


def _escaped_length(column: str) -> str:
    """A backslash more for each backslash and control string."""
    return (
        f"length({column}) + length({column}) - length(replace({column}, chr(92), ''))"
        f" + len(regexp_extract_all({column}, '{_CONTROL}'))"
    )


ORACLE["op4_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]'
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), sized AS (
  SELECT *, sum(length('<|im_start|><|im_sep|><|im_end|>') + {_escaped_length("role")}
      + {_escaped_length("text")}) OVER w AS upto,
    row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
#: kind, its place among the kinds, pattern, group of the value, least code points of it
_SECRETS = (
    ("assign", 0, _ASSIGN, 2, 8),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    ("hex", 2, "[0-9a-f]+", 0, 32),
    ("random", 3, "[A-Za-z0-9+/_=-]+", 0, 20),
)
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, source, '{kind}' AS kind, {order} AS kind_order, {group} AS grp, {least} AS least,
      regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS vals,
      regexp_split_to_array(text, '{pattern}') AS gaps
    FROM doc WHERE regexp_matches(text, '{pattern}')"""
    for kind, order, pattern, group, least in _SECRETS
)

ORACLE["op5_secret_scans"] = f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), matches AS ({_MATCHES}), places AS (
  SELECT doc_id, source, kind, kind_order, least, unnest(found) AS match, unnest(vals) AS value,
    unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS place
  FROM matches
), spans AS (
  SELECT doc_id, source, kind, kind_order, least, value,
    sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY place) AS end_at,
    length(match) AS size
  FROM places
), kept AS (
  SELECT *, end_at - size AS start_at FROM spans WHERE length(value) >= least
), held AS (
  SELECT value, count(DISTINCT source) AS repositories,
    count(DISTINCT split_part(source, '/', 1)) AS owners
  FROM kept GROUP BY value
), judged AS (
  SELECT k.*, owners <= 2 AND repositories <= 3
    AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|test|xxxx|your|1234567')
    AND len(list_distinct(string_split(value, ''))) >= 8
    AND (kind <> 'random' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]')
      AND regexp_matches(value, '[A-Z]'))) AS live
  FROM kept k JOIN held h USING (value)
), found AS (
  SELECT * FROM judged j WHERE kind <> 'random' OR (live AND NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.doc_id = j.doc_id AND b.kind <> 'random'
      AND b.start_at < j.end_at AND b.end_at > j.start_at))
), told AS (
  SELECT *, kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT) AS span FROM found
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
    string_agg(span, ',' ORDER BY start_at, kind_order) FILTER (kind <> 'random') AS base,
    string_agg(span, ',' ORDER BY start_at, kind_order) AS spans
  FROM told GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM doc d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""

ORACLE["op6_benchmark_decontamination"] = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized)
), doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), sizes AS (
  SELECT DISTINCT size FROM windows
), spots AS (
  SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
  FROM doc, sizes WHERE len(w) >= size
), matched AS (
  SELECT doc_id, i, s.size, item_id
  FROM spots s JOIN windows v ON s.size = v.size AND array_to_string(w[i:i + s.size - 1], ' ') = v.win
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM matched) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM matched) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

ORACLE["op10_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), {_UPPER}, {_LOWER}) AS key FROM split
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_TRIMMED = f"trim(text, {_BLANK})"

ORACLE["op13_conversation_repair"] = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), faulty AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
        || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 + 1 AS INTEGER)]))) % 20 AS fault
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0
), coded AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, {_TRIMMED} = '' AS blank,
    row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text
      ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    right({_TRIMMED}, 1) NOT IN ('.', '!', '?') AS cut_off,
    lag(left(role, 1)) OVER w AS before
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy)
), inserts(p, m, letters, extra, lines) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
    (0, 2, 'I', 2, 'user:' || chr(10)), (1, 2, 'I', 2, 'user:' || chr(10)), (3, 2, 'I', 2, 'user:' || chr(10)),
    (2, 3, 'I', 2, 'assistant:' || chr(10)),
    (0, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
    (1, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
    (3, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 2, 'II', 4, 'assistant:' || chr(10) || 'user:' || chr(10))
), edits(m, q, letter, initial, price) AS (
  SELECT m, m, 'D', '', 3 FROM (VALUES (0), (1), (2), (3)) AS v(m)
  UNION ALL VALUES (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0),
    (2, 3, 'K', 'a', 0), (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (3, 2, 'R', '', 2), (2, 3, 'R', '', 2)
), path AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, 0 AS state,
    {{'cost': 0, 'audit': '', 'lines': ''}} AS best FROM coded
  UNION ALL
  SELECT a.conv_id, r.place, e.q, min({{
    'cost': a.best.cost + i.extra + e.price + CASE WHEN e.letter <> 'D' AND r.cut_off THEN 1 ELSE 0 END,
    'audit': a.best.audit || i.letters || e.letter,
    'lines': a.best.lines || i.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10)
      ELSE CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text || chr(10) END}})
  FROM path a JOIN coded r ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = a.place + 1
    JOIN inserts i ON i.p = a.state JOIN edits e ON e.m = i.m
  WHERE e.letter = 'D' OR NOT (r.blank OR r.seen) AND (e.letter = 'R' OR e.initial = r.initial)
  GROUP BY a.conv_id, r.place, e.q
), figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT blank AND NOT seen AND cut_off) AS truncated,
    count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id
), ended AS (
  SELECT f.conv_id, min({{'cost': a.best.cost + i.extra, 'audit': a.best.audit || i.letters,
    'lines': a.best.lines || i.lines}}) AS best
  FROM figures f JOIN path a ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.place = f.n
    JOIN inserts i ON i.p = a.state AND (i.m = 3 OR i.m = 0)
  GROUP BY f.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(left(e.best.lines, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_WORD_LIST = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE["op11_substring_dedup"] = f"""
WITH doc AS (
  SELECT doc_id, {_WORD_LIST} AS words FROM documents
), windows AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM doc
), hashed AS (
  SELECT doc_id, start, sha256(array_to_string(list_slice(words, start, start + 49), ' ')) AS h FROM windows
), hits AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY h) AS first FROM hashed)
  WHERE first < doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(start, start + 50)) AS place FROM hits) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words
    ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i])
    END AS words
  FROM doc d LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept
"""
