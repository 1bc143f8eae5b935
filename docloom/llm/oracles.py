"""DuckDB statements of the training-data queries that SQL can express."""

from docloom.llm.quality_rules import BASE_RULES, POLICIES

SQL: dict[str, str] = {}

SQL["op3_quality_rules"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
             list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM t),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
             len(lines)::BIGINT AS n_text_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *,
        (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
       + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
       + CASE WHEN 100 * n_dup_lines > 60 * n_text_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
       + CASE WHEN 100 * n_capitals > 60 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'v3' AS policy
FROM b
"""

SQL["op5_line_dedup"] = """
WITH l AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
s AS (SELECT k, min(doc_id) AS holder FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND l.doc_id <> s.holder AS lost FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(lost::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

SQL["op12_conversation_trie"] = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 40)) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 'x': x} ORDER BY p) AS s FROM t GROUP BY c),
crc AS (
  SELECT c, s, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ord(z)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT crc.c, list_concat(coalesce(own.s[1:h], []), crc.s[h + 1:]) AS s
  FROM crc LEFT JOIN own ON own.c = crc.c - ((crc.c % 5) + 5) % 5),
path AS (SELECT c, d, len(s) AS len, s[1:d] AS k, s[1:greatest(d - 1, 0)] AS up FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT d, k, up, min(c) AS conv, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].x) END AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends
  FROM path GROUP BY d, k, up),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
shape AS (
  SELECT node.*, p.conv AS parent, coalesce(kids.n, 0) AS n_children
  FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k
            LEFT JOIN node AS p ON node.d > 0 AND p.d = node.d - 1 AND p.k = node.up),
spot AS (SELECT path.c, path.d, node.conv FROM path JOIN node ON path.d = node.d AND path.k = node.k),
sub AS (
  SELECT spot.conv, spot.d, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.bytes) AS saved
  FROM shape AS u JOIN spot ON spot.c = u.conv AND spot.d <= u.d GROUP BY 1, 2)
SELECT shape.conv AS conv_id, shape.d AS depth, parent AS parent_conv_id, n AS n_convs, n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM shape JOIN sub ON sub.conv = shape.conv AND sub.d = shape.d
"""

SQL["op13_collocations"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k))),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY lang, k, ws HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cut AS (
  SELECT c.lang, c.k, c.ws, c.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) AS c
  JOIN f AS x ON x.lang = c.lang AND x.ws = c.ws[1:j] JOIN f AS y ON y.lang = c.lang AND y.ws = c.ws[j + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
part AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(f) AS longer
  FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM f JOIN (VALUES (2), (3)) AS sizes(m) ON m < k) GROUP BY 1, 2),
kept AS (
  SELECT best.*, array_to_string(best.ws, ' ') AS phrase FROM best LEFT JOIN part ON part.lang = best.lang AND part.ws = best.ws
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

assert set(BASE_RULES) <= set(POLICIES["v3"])
