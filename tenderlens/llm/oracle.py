"""DuckDB SQL for those queries opN_<name> that SQL can express."""

from __future__ import annotations

import string

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
NO_HASH = "sha256('')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 11)) AS a, unnest(list_transform(range(1, len(l) - 11), lambda a: array_to_string(l[a:a + 12], ' '))) AS g FROM d WHERE len(l) >= 13),
f AS (SELECT g, min(doc_id) AS source FROM w GROUP BY g),
gone AS (SELECT DISTINCT doc_id, a + o AS p FROM (SELECT w.doc_id, w.a, unnest(range(0, 13)) AS o FROM w JOIN f USING (g) WHERE f.source < w.doc_id) x),
t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM d),
k AS (SELECT t.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, len(d.l) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level FROM o WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate, CAST(CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, least(CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM n
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) x WHERE rank <= 5
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) ELSE [array_to_string(l, ' ')] END) AS g FROM d) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.x, p.y, p.c = a.n AND p.c = b.n AS same FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 5 * p.c >= 4 * (a.n + b.n - p.c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
k AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id),
m AS (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM l GROUP BY x)
SELECT k.doc_id, k.class_id, coalesce(m.n_links, 0) AS n_links, coalesce(m.copies, 0) + 1 AS n_copies FROM k LEFT JOIN m USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS l FROM documents),
i AS (SELECT item_id, l, least(13, len(l)) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM} AS l FROM benchmark) x WHERE len(l) > 0),
w AS (SELECT DISTINCT item_id, k, g FROM (SELECT item_id, k, unnest(list_transform(range(1, len(l) - k + 2), lambda a: array_to_string(l[a:a + k - 1], ' '))) AS g FROM i) x),
t AS (SELECT doc_id, k, unnest(range(1, len(l) - k + 2)) AS a, unnest(list_transform(range(1, len(l) - k + 2), lambda a: array_to_string(l[a:a + k - 1], ' '))) AS g FROM d CROSS JOIN (SELECT DISTINCT k FROM i) z WHERE len(l) >= k),
h AS (SELECT t.doc_id, t.k, t.a, w.item_id FROM t JOIN w ON w.k = t.k AND w.g = t.g),
c AS (SELECT doc_id, count(DISTINCT a + o) AS n_hit FROM (SELECT doc_id, a, unnest(range(0, k)) AS o FROM h) x GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) x GROUP BY doc_id)
SELECT d.doc_id, len(d.l) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(e.n_items, 0) AS n_items, coalesce(e.items_sha256, {NO_HASH}) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.l) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, a, md5(substr(x, CAST(2 * a + 1 AS BIGINT), 200)) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS a FROM d WHERE n >= 100) y),
r AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) AS k FROM w) y WHERE k > 1),
s AS (SELECT doc_id, a, coalesce(a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 100, true) AS fresh FROM r),
i AS (SELECT doc_id, a, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM s),
e AS (SELECT doc_id, k, min(a) AS a, max(a) + 100 AS b FROM i GROUP BY doc_id, k),
m AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM e GROUP BY doc_id),
j AS (SELECT d.doc_id, d.n, d.x, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], coalesce(ends, [])) AS froms, list_concat(coalesce(starts, []), [d.n]) AS tos FROM d LEFT JOIN m USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda q: substr(x, CAST(2 * froms[q] + 1 AS BIGINT), CAST(2 * (tos[q] - froms[q]) AS BIGINT))), ''))) AS kept_sha256 FROM j
"""

ORACLES = {
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op3_mixing": MIXING,
    "op7_exact_topk": TOP_K,
    "op8_ngram_jaccard_join": JACCARD,
    "op9_decontamination": DECONTAMINATION,
    "op13_suffix_dedup": SUFFIX_DEDUP,
}
