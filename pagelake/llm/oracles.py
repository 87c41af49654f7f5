"""DuckDB twins of the opN_ queries that SQL can express.

The others have none: a tokenizer (1, 8), hypervectors (4), an HTML parser (5), XOR sketches (6) and a map balanced
step by step (7) are beyond it; tests hold those against brute-force versions.
"""

from __future__ import annotations

from pagelake.llm.secret_scan import RULES

ALPHABET, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: 32 digits of 5 bits out of the 40 of 4 bits of the hexadecimal digest.
OP2 = f"""WITH d AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}234567', CAST(1 + (((
    (instr('0123456789abcdef', substr(hex, CAST(1 + (5 * i) // 4 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, CAST(2 + (5 * i) // 4 AS BIGINT), 1)) - 1)
    >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x"""


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(x, '{p}') AS p, regexp_extract_all(x, '{p}', 0) AS m, regexp_extract_all(x, '{p}', {group}) AS g FROM t"


OP3 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k AS ({" UNION ALL ".join(_matches(i, r.kind, r.pattern, r.group, r.min_length) for i, r in enumerate(RULES))}),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
f AS (SELECT doc_id, kind, rank, CAST(list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS a, length(m[i]) AS w FROM s WHERE length(g[i]) >= least),
o AS (SELECT t.doc_id, x, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || (a + w), ',' ORDER BY a, rank), '') AS spans FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id, x)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans, sha256(x) AS blob FROM o"""

OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dk AS (SELECT * FROM d, (SELECT DISTINCT k FROM pat)),
occ AS (SELECT doc_id, i, v.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM dk WHERE len(w) >= k)) v JOIN pat ON v.k = pat.k AND v.win = pat.win),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT DISTINCT a AS src, a AS got FROM l UNION SELECT r.src, l.b FROM r JOIN l ON l.a = r.got),
c AS (SELECT src, min(got) AS component_id FROM r GROUP BY src)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.src = d.doc_id"""

OP11 = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fail FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fail, count(*) AS n FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
h AS (SELECT g.*, filter_order, list_min(list_filter(range(1, 6), lambda i: fail[instr('ABCDE', substr(filter_order, CAST(i AS BIGINT), 1))])) AS first FROM g, o),
s AS (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM h),
y AS (SELECT *, substr(filter_order, step, 1) AS letter, fail[instr('ABCDE', substr(filter_order, step, 1))] AS fails FROM s),
z AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (first IS NULL OR first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND first < step), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(fail, lambda v: v)) = 1), 0) AS unique_fails,
  coalesce(sum(n) FILTER (first = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z"""

#: crc32 by its table of 256 entries, which a list makes out of the polynomial.
OP12 = """WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) AS k),
o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, list({'r': r, 't': t} ORDER BY i) AS own FROM o GROUP BY conv_id),
h AS (SELECT c, own, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: xor(a >> 8, k[1 + (xor(a, b) & 255)])), 4294967295) % 4 AS h FROM c, k),
b AS (SELECT h.c, list_concat(coalesce(list_slice(p.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS s FROM h LEFT JOIN c p ON p.c = h.c - h.c % 20),
e AS (SELECT c, s, CAST(len(s) AS BIGINT) AS n, unnest(range(0, len(s) + 1)) AS d FROM b),
v AS (SELECT list_slice(s, 1, d) AS v, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '') AS ends FROM e GROUP BY ALL),
q AS (SELECT list_slice(v, 1, depth - 1) AS v, depth - 1 AS depth, count(*) AS n FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(q.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(v[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM v LEFT JOIN q USING (v, depth)),
u AS (SELECT list_slice(v, 1, a) AS v, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u USING (v, depth) LEFT JOIN v p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.v = list_slice(w.v, 1, w.depth - 1)"""

OP13 = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
