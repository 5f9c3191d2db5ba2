"""SQL for the results of the queries that SQL can express."""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes o ON o.doc_id = p.b WHERE 100 * k >= 80 * (m.n + o.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n
"""

#: The messages of the conversations ``src``, as rows ``placed``.
_MESSAGES = r"""
m AS (SELECT conv_id, turn, role, text, count(*) AS copies, row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid FROM src GROUP BY conv_id, turn, role, text),
raw AS (SELECT mid, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS raw, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) AS i FROM m),
lev AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level FROM raw),
lines AS (
  SELECT mid, i, level, CASE WHEN level = 0 AND regexp_matches(raw, '(?i)^on .*\bwrote:[ \t]*$') AND coalesce(lead(level) OVER w, 0) > 0 THEN '' ELSE regexp_replace(raw, '^[ \t]*((?:>[ \t]*)+)', '') END AS t,
         CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS new FROM lev WINDOW w AS (PARTITION BY mid ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY mid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM lines),
runs AS (SELECT mid, run, level, string_agg(t, chr(10) ORDER BY i) AS t FROM numbered GROUP BY mid, run, level),
own AS (SELECT mid, trim(string_agg(t, chr(10) ORDER BY run) FILTER (WHERE level = 0), chr(32) || chr(9) || chr(10) || chr(13)) AS content, max(level) AS levels FROM runs GROUP BY mid),
msg AS (SELECT m.*, coalesce(own.content, '') AS content, own.levels FROM m JOIN own USING (mid)),
units AS (
  SELECT mid, content AS u FROM msg UNION ALL SELECT mid, t FROM runs WHERE level = 0
  UNION ALL SELECT mid, unnest(string_split_regex(content, '\n[ \t]*\n')) FROM msg UNION ALL SELECT mid, unnest(string_split(content, chr(10))) FROM msg),
origins AS (
  SELECT conv_id, trim(regexp_replace(lower(u), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS p, min(turn) AS origin FROM units JOIN m USING (mid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
quoted AS (
  SELECT mid, run, level, true AS whole, t AS u FROM runs WHERE level > 0 UNION ALL SELECT mid, run, level, false, unnest(string_split(t, chr(10))) FROM runs WHERE level > 0),
met AS (
  SELECT q.mid, q.run, q.level, q.whole, o.origin FROM (SELECT quoted.*, trim(regexp_replace(lower(u), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS p, conv_id, turn FROM quoted JOIN m USING (mid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL) q
  LEFT JOIN origins o ON o.conv_id = q.conv_id AND o.p = q.p AND o.origin < q.turn WHERE q.p <> ''),
votes AS (SELECT mid, run, level, origin, max(whole::INT) AS whole, count(*) AS n FROM met GROUP BY mid, run, level, origin),
chosen AS (
  SELECT *, max(n) OVER (PARTITION BY mid, run) AS top, row_number() OVER (PARTITION BY mid, run ORDER BY origin IS NULL, whole DESC, n DESC, origin) AS r FROM votes),
link AS (SELECT mid, level, origin, whole, top FROM chosen WHERE r = 1),
per AS (
  SELECT mid, count(*) AS n_quotes, count(origin) AS n_linked, (arg_max(origin, [whole, top, -origin]) FILTER (WHERE level = 1 AND origin IS NOT NULL)) AS parent FROM link GROUP BY mid),
up AS (SELECT conv_id, turn, min(parent) AS parent FROM per JOIN m USING (mid) WHERE parent IS NOT NULL GROUP BY conv_id, turn),
turns AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
tree AS (
  SELECT conv_id, turn, [turn] AS path FROM turns t WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.conv_id = t.conv_id AND u.turn = t.turn)
  UNION ALL SELECT u.conv_id, u.turn, list_append(t.path, u.turn) FROM up u JOIN tree t ON t.conv_id = u.conv_id AND t.turn = u.parent),
placed AS (
  SELECT msg.conv_id, msg.turn, msg.role,
       CASE WHEN path IS NOT NULL THEN row_number() OVER (PARTITION BY msg.conv_id, path IS NULL ORDER BY path, msg.role NULLS FIRST, msg.text NULLS FIRST) - 1 END::BIGINT AS place,
       msg.copies::BIGINT AS copies, msg.levels::BIGINT AS quote_levels, coalesce(per.n_quotes, 0)::BIGINT AS n_quotes, coalesce(per.n_linked, 0)::BIGINT AS n_linked, per.parent AS parent_turn,
       coalesce(path[1], msg.turn) AS root_turn, coalesce(len(path) - 1, 0)::BIGINT AS depth,
       '<|' || coalesce(msg.role, 'unknown') || '|>' || chr(10) || msg.content || chr(10) || '<|end|>' AS formatted
  FROM msg LEFT JOIN per ON per.mid = msg.mid LEFT JOIN tree ON tree.conv_id = msg.conv_id AND tree.turn = msg.turn)
"""

OP10_MESSAGES = "WITH RECURSIVE src AS (SELECT * FROM conversations)," + _MESSAGES + "SELECT * FROM placed"

OP10 = r"""
WITH RECURSIVE q AS (SELECT conv_id, turn AS source, min(text) AS quoted FROM conversations GROUP BY conv_id, turn),
src AS (
  SELECT conv_id, turn, role, CASE WHEN coalesce(quoted, '') <> '' THEN 'On Monday, someone wrote:' || chr(10) || '> ' || replace(CASE WHEN turn % 2 = 0 THEN quoted ELSE split_part(quoted, chr(10), 1) END, chr(10), chr(10) || '> ')
    || chr(10) || chr(10) || coalesce(text, '') ELSE text END AS text
  FROM (SELECT *, CASE WHEN turn > 0 THEN greatest(turn - 1 - turn % 3, 0) END AS source FROM conversations) c LEFT JOIN q USING (conv_id, source)),
""" + _MESSAGES + r"""
SELECT conv_id, coalesce(place // 64, -1)::BIGINT AS part, count(*)::BIGINT AS n_messages, sum(n_quotes)::BIGINT AS n_quotes, sum(n_linked)::BIGINT AS n_linked,
       string_agg(coalesce(turn::VARCHAR, '?') || '<' || coalesce(parent_turn::VARCHAR, '-') || '/' || depth, ',' ORDER BY place) AS replies, string_agg(formatted, chr(10) ORDER BY place) AS conversation
FROM placed GROUP BY conv_id, place // 64, CASE WHEN place IS NULL THEN formatted END
"""

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

RULE_COUNTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM d),
runs AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM w WHERE len(w) >= 5),
named AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS run FROM runs),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS k FROM named) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS place FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(k - 1) AS n FROM lines GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(repeats.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id)
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"""

WORD_SCORES = rf"""
WITH d AS (SELECT doc_id, {_CRC32.format('doc_id')} % 5 = 1 AS held_out, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n.n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)))), 5) AS base_score
FROM t LEFT JOIN c USING (t) CROSS JOIN n GROUP BY doc_id, held_out
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
phrases AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM phrases GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, p.a AS l, q.a AS r, (1000000::HUGEINT * c.a * c.a // (p.a::HUGEINT * q.a))::BIGINT AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(w[1:cut], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(w[cut + 1:], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY lang, part),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, phrase) AS rank
  FROM least s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * s.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

EDITED_TEXTS = """
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256
FROM (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST)) AS following FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
"""

SQL = {"op2_ngram_jaccard": OP2, "op5_exact_topk": OP5, "op10_quotation_linking": OP10, "rule_counts": RULE_COUNTS, "word_scores": WORD_SCORES, "op12_collocations": COLLOCATIONS, "edited_texts": EDITED_TEXTS}
