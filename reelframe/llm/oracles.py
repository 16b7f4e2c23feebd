"""DuckDB SQL of the operators that SQL expresses whole, for tables with one row per doc_id."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def suffix_dedup(length: int = 200) -> str:
    """Every string of length bytes as hex, the places where one that stands elsewhere too begins, and their union."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS k FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM t WHERE n >= {length})),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM r GROUP BY doc_id, run),
q AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
u AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN u USING (doc_id)"""


def ngram_join(size: int = 5, percent: int = 80) -> str:
    """Sets of shingles, every pair of documents that share one, and the smallest document along the links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents),
s AS (SELECT doc_id, md5(g) AS g FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
 ELSE list_transform(range(1, len(words) - {size - 2}), lambda i: array_to_string(words[i:i + {size - 1}], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= {percent} * (p.n + q.n - common)),
reach AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other),
m AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, coalesce(links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)"""


def quality_rules(min_documents: int = 20, share: float = 0.01, min_kept: float = 0.3) -> str:
    """The base counts, distinct documents (sets of normalised lines) per host and line, and the verdict."""
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '{WORDS}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM t),
u AS (SELECT doc_id, unnest(words) AS w0, generate_subscripts(words, 1) AS i FROM w),
v AS (SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w0, w1, w2) AS c FROM v WHERE w2 IS NOT NULL) WHERE c > 1),
y AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x) GROUP BY doc_id),
l AS (SELECT doc_id, host, list_transform(lines, lambda x: array_to_string(regexp_extract_all(translate(x, '{UPPER}', '{LOWER}'), '{WORDS}'), ' ')) AS lines FROM w),
d AS (SELECT host, list_sort(list_distinct(lines)) AS own FROM l GROUP BY 1, 2),
h AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, unnest(own) AS line FROM d) JOIN h USING (host) GROUP BY host, line, documents HAVING count(*) >= {min_documents} AND count(*) >= {share}::DOUBLE * documents),
r AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS removed FROM (SELECT doc_id, host, unnest(lines) AS line FROM l) SEMI JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words FROM w LEFT JOIN y USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < {min_kept}::DOUBLE * n_words) AS kept FROM b"""
