"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * s AS c FROM t),
l AS (SELECT *, c / w AS r, row_number() OVER (ORDER BY c / w, source NULLS LAST) AS place,
             (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, s, coalesce(least(c, w * (SELECT arg_min(level, place) FROM l WHERE r >= level)), c)::DOUBLE AS target FROM l),
p AS (SELECT d.*, g.s, g.target, floor(g.target)::BIGINT AS words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN s > 0 THEN words // s ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, s AS source_size, target, (epochs * size + least(greatest(words - epochs * s - before, 0), size))::BIGINT AS taken FROM e
"""

WORDS_OF = rf"regexp_extract_all(coalesce(text, ''), {WORDS})"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS_OF} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1)))::BIGINT AS pos FROM d),
h AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 34), ' ') AS win FROM x),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n FROM h),
c AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 35)) AS k FROM r WHERE n > 1) GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([v FOR v, i IN w IF NOT list_contains(gone, i)], ' '), '')) AS kept_sha256 FROM k
"""

PREFERENCE = r"""
WITH o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, max(pos) FILTER (role = 'assistant') AS last FROM o GROUP BY conv_id),
a AS (SELECT conv_id, text AS reply FROM o JOIN z USING (conv_id) WHERE pos = last),
b AS (SELECT conv_id AS pair_id, true AS side, pos, role, text FROM o JOIN z USING (conv_id) WHERE last IS NULL OR pos <= last
      UNION ALL
      SELECT o.conv_id, false, pos, role, CASE WHEN pos = last THEN reply ELSE text END
      FROM o JOIN z USING (conv_id) JOIN a ON a.conv_id = o.conv_id + 1 WHERE pos <= last),
t AS (SELECT *, '<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) AS head,
             replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM b),
n AS (SELECT pair_id, count(*) FILTER (side) AS nc, count(*) FILTER (NOT side) AS nr FROM t GROUP BY pair_id),
m AS (SELECT c.pair_id, min(c.pos) AS bad FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.side AND NOT r.side
      WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id),
l AS (SELECT n.pair_id, nc > 0 AND nr > 0 AS paired, coalesce(m.bad - 1, least(nc, nr))::INT AS n_common FROM n LEFT JOIN m USING (pair_id)),
x AS (SELECT t.*, paired, n_common, length(head) || ':0,' || length(body) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS runs FROM t JOIN l USING (pair_id))
SELECT pair_id, any_value(paired) AS paired, any_value(n_common) AS n_common,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side AND pos <= n_common), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side AND pos > n_common), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT side AND pos > n_common), '') AS rejected,
       coalesce(string_agg(runs, ',' ORDER BY pos) FILTER (side AND pos > n_common), '') AS chosen_mask,
       coalesce(string_agg(runs, ',' ORDER BY pos) FILTER (NOT side AND pos > n_common), '') AS rejected_mask
FROM x GROUP BY pair_id
"""

_NORMAL = r"""list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, {_NORMAL} AS w, least(len(w), 5) AS k FROM benchmark WHERE item_id IS NOT NULL AND len(w) > 0),
ks AS (SELECT DISTINCT k FROM i),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d JOIN ks ON len(w) >= k),
ip AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM i),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS gram FROM dp),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS gram FROM ip),
q AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (gram) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM s JOIN q USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS gram FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS i, doc_id AS j FROM d UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
m AS (SELECT i AS doc_id, min(j) AS component_id FROM r GROUP BY i)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
