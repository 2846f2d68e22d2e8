"""DuckDB SQL of the queries that SQL can say."""

from __future__ import annotations

from .ngram_join import GRAM, PERCENT
from .quality import BOILERPLATE, BOILERPLATE_CHARS, LEAST_WORDS, MARK_EVERY, MOST_LOST, SENTENCE_END, SUSPECT

_SPACE = r"[\x20\x09-\x0D]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = f"list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {GRAM} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i:i + {GRAM - 1}], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a WHERE r.label < e.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.label AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(label) AS label FROM r GROUP BY node) m ON m.node = doc_id
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, a, b, c)) GROUP BY doc_id),
l AS (SELECT doc_id, l, regexp_matches(t, {_quoted(SUSPECT)}) AS suspect, len(list_filter(regexp_split_to_array(l, '{_SPACE}'), lambda x: x <> '')) AS n
    FROM (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
f AS (SELECT doc_id, l, n, NOT regexp_matches(l, {_quoted(SENTENCE_END)})
    OR (suspect AND (length(regexp_replace(l, '[^|»•·]', '', 'g')) >= 2
        OR (length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) + length(l) - length(replace(l, '!!', ''))) * {MARK_EVERY} > n))
    OR (length(l) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(l), {_quoted(BOILERPLATE)})) AS bad FROM l),
p AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS n_words_removed FROM f GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
    FROM w LEFT JOIN p USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words_removed <= {MOST_LOST} * n_words AS kept FROM m
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
h AS (SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM h JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 20
"""

_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM t GROUP BY conv_id),
h AS (SELECT *, xor({_CRC32}, 4294967295) % 9 AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.ids, [])[1:a.h], a.ids[a.h + 1:]) AS ids FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, unnest(range(len(ids) + 1)) AS depth, ids FROM r),
n AS (SELECT depth, ids[1:depth] AS way, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '')) AS ends_sha256 FROM p GROUP BY depth, way),
s AS (SELECT id, any_value(size) AS size FROM t GROUP BY id),
k AS (SELECT depth - 1 AS depth, way[1:depth - 1] AS way, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
c AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(size, 0) AS own FROM n LEFT JOIN k USING (depth, way) LEFT JOIN s ON s.id = way[depth]),
u AS (SELECT way[1:d] AS way, d AS depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM c) GROUP BY ALL)
SELECT c.conv_id, c.depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM c JOIN u ON u.depth = c.depth AND u.way = c.way LEFT JOIN n q ON q.depth = c.depth - 1 AND q.way = c.way[1:c.depth - 1]
"""

ORACLE = {"op5_ngram_jaccard": JACCARD, "op7_quality_rules": QUALITY, "op12_prefix_trie": TRIE, "op13_ranked_search": RANKED}
