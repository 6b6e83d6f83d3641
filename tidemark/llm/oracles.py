"""The operators' results in DuckDB's SQL, each by the plainest way: all windows, all pairs, all links."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 33), lambda p: struct_pack(p := p, k := md5(array_to_string(ws[p:p + 34], ' '))))) AS x FROM docs WHERE len(ws) >= 35),
twice AS (SELECT x.k AS k FROM windows GROUP BY x.k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, x.p + o AS pos FROM windows JOIN twice ON x.k = twice.k, range(0, 35) r(o)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN lost l ON l.doc_id = d.doc_id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

VECTORS = """
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x != 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

_SHINGLES = "list_transform(range(1, len(ws) - {k} + 2), lambda p: array_to_string(ws[p:p + {k} - 1], ' '))"

CONTAMINATION = rf"""
WITH items AS (SELECT item_id, ws, len(ws) AS m, least(5, len(ws)) AS k FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x != '') AS ws FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0),
places AS (SELECT item_id, m, k, unnest({_SHINGLES.format(k="k")}) AS s, unnest(range(0, m - k + 1)) AS o FROM items),
bag0 AS (SELECT item_id, m, s, count(*) AS c FROM places GROUP BY ALL), df AS (SELECT s, count(DISTINCT item_id) AS df FROM bag0 GROUP BY s), many AS (SELECT count(DISTINCT item_id) AS n FROM items),
bag AS (SELECT item_id, m, s, c, round(ln(1 + n / df) * 1000)::BIGINT AS w FROM bag0 JOIN df USING (s), many), top AS (SELECT round(ln(1 + n) * 1000)::BIGINT AS top FROM many),
docs AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x != '') AS ws FROM documents),
seen AS (SELECT doc_id, len(ws) AS n, k, unnest({_SHINGLES.format(k="k")}) AS s, unnest(range(0, len(ws) - k + 1)) AS p FROM docs, (SELECT DISTINCT k FROM items) WHERE len(ws) >= k),
met AS (SELECT DISTINCT doc_id, n, k, m, p FROM seen JOIN places USING (k, s)),
spots AS (SELECT DISTINCT doc_id, k, m, unnest(range(greatest(0, least(p - m + k, n - m)), greatest(0, least(p, n - m)) + 1)) AS st FROM met),
cut AS (SELECT doc_id, k, m, st, ws[st + 1:st + m] AS ws FROM spots JOIN docs USING (doc_id)),
wbag AS (SELECT doc_id, m, st, s, count(*) AS d FROM (SELECT doc_id, m, st, unnest({_SHINGLES.format(k="k")}) AS s FROM cut) GROUP BY ALL), total AS (SELECT doc_id, m, st, sum(d) AS d FROM wbag GROUP BY ALL),
pairs AS (SELECT t.doc_id, t.m, t.st, t.d AS all_d, b.item_id, sum(b.w * least(b.c, coalesce(x.d, 0))) AS common, sum(b.w * greatest(b.c, coalesce(x.d, 0))) AS either, sum(coalesce(x.d, 0)) AS known
  FROM total t JOIN bag b ON b.m = t.m LEFT JOIN wbag x ON x.doc_id = t.doc_id AND x.m = t.m AND x.st = t.st AND x.s = b.s GROUP BY ALL),
found AS (SELECT doc_id, item_id, common / (either + (all_d - known) * top) AS similarity FROM pairs, top WHERE common > 0 AND common * 100 >= (either + (all_d - known) * top) * 80),
best AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, max(similarity) AS similarity FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(b.item_ids), 0)::BIGINT AS n_items, coalesce(b.item_ids, []) AS item_ids, round(coalesce(b.similarity, 0), 6)::DOUBLE AS similarity, b.doc_id IS NULL AS kept FROM docs d LEFT JOIN best b ON b.doc_id = d.doc_id
"""
