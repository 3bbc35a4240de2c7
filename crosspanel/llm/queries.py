"""The queries of this subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from crosspanel.llm.bpe import op6_bpe
from crosspanel.llm.clusters import op12_clusters
from crosspanel.llm.decontaminate import op3_decontaminate
from crosspanel.llm.html import op5_html
from crosspanel.llm.lines import op11_lines
from crosspanel.llm.lm import op8_lm
from crosspanel.llm.negatives import op13_negatives
from crosspanel.llm.neighbours import op10_neighbours
from crosspanel.llm.quality import op9_quality
from crosspanel.llm.simhash import op1_simhash
from crosspanel.llm.substring import op7_substring
from crosspanel.llm.suffix import op2_suffix
from crosspanel.llm.toxicity import op4_toxicity

#: Windows of 35 words are counted; words that a repeated one covers are left out.
OP7 = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, regexp_extract_all(COALESCE(text, ''), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
s AS (SELECT k, p, hash(w[p:p + 34]) AS a, md5(array_to_string(w[p:p + 34], ' ')) AS b FROM (SELECT k, w, UNNEST(RANGE(1, LEN(w) - 33)) AS p FROM d) q),
r AS (SELECT k, p FROM (SELECT k, p, COUNT(*) OVER (PARTITION BY a, b) AS n FROM s) q WHERE n > 1),
c AS (SELECT DISTINCT k, UNNEST(RANGE(p, p + 35)) AS p FROM r),
x AS (SELECT k, UNNEST(w) AS word, UNNEST(RANGE(1, LEN(w) + 1)) AS p FROM d),
f AS (SELECT x.k, COUNT(*) FILTER (WHERE c.p IS NOT NULL) AS gone, STRING_AGG(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN c ON c.k = x.k AND c.p = x.p GROUP BY x.k)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN f ON f.k = d.k
"""

#: Windows of 200 bytes, as hexadecimal digits, are counted; what repeated ones cover is cut out stretch by stretch.
OP2 = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
s AS (SELECT k, p, md5(SUBSTR(h, 2 * p - 1, 400)) AS a FROM (SELECT k, h, UNNEST(RANGE(1, LEN(h) // 2 - 198)) AS p FROM d) q),
r AS (SELECT k, p FROM (SELECT k, p, COUNT(*) OVER (PARTITION BY a) AS n FROM s) q WHERE n > 1),
j AS (SELECT k, p, SUM(new) OVER (PARTITION BY k ORDER BY p) AS g FROM (SELECT k, p, CASE WHEN p > LAG(p) OVER (PARTITION BY k ORDER BY p) + 200 THEN 1 ELSE 0 END AS new FROM r) q),
i AS (SELECT k, MIN(p) AS a, MAX(p) + 199 AS b FROM j GROUP BY k, g),
c AS (SELECT k, a, b, COALESCE(LAG(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM i),
f AS (SELECT c.k, SUM(b - a + 1) AS gone, COUNT(*) AS spans, MAX(b) AS last, STRING_AGG(SUBSTR(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head FROM c JOIN d ON d.k = c.k GROUP BY c.k)
SELECT doc_id, CAST(LEN(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(COALESCE(head, '') || SUBSTR(h, 2 * COALESCE(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN f ON f.k = d.k
"""

OP11 = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, string_split(COALESCE(text, ''), chr(10)) AS w FROM documents),
x AS (SELECT k, doc_id, UNNEST(w) AS line, UNNEST(RANGE(1, LEN(w) + 1)) AS p FROM d),
y AS (SELECT k, doc_id, line, p, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
b AS (SELECT key, MAX(doc_id) AS keeper FROM y WHERE LENGTH(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
f AS (SELECT k, COUNT(*) AS n, COUNT(*) FILTER (WHERE doc_id <> keeper) AS gone, STRING_AGG(line, chr(10) ORDER BY p) FILTER (WHERE keeper IS NULL OR doc_id = keeper) AS kept FROM y LEFT JOIN b ON b.key = y.key GROUP BY k)
SELECT doc_id, n AS n_lines, gone AS n_dropped, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d JOIN f ON f.k = d.k
"""

#: Assignment and centroids of each round in turn; sums of whole numbers of this size are exact as doubles.
_NEAR = "a{i} AS (SELECT r, v, cluster, d FROM (SELECT r, v, cluster, d, ROW_NUMBER() OVER (PARTITION BY r ORDER BY d, cluster) AS o FROM (SELECT r, v, cluster, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) AS d FROM k, c{i}) q) q WHERE o = 1)"
_MEAN = "c{j} AS (SELECT c{i}.cluster, COALESCE(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, LIST(f ORDER BY p) AS c FROM (SELECT cluster, p, floor(SUM(x) / COUNT(*)) AS f FROM (SELECT cluster, UNNEST(v) AS x, UNNEST(RANGE(1, 65)) AS p FROM a{i}) q GROUP BY cluster, p) q GROUP BY cluster) m ON m.cluster = c{i}.cluster)"
_VALID = "embedding IS NOT NULL AND LEN([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = LEN(embedding)"
_FLOORS = "[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding]"
OP12 = (
    f"WITH k AS (SELECT ROW_NUMBER() OVER () AS r, vec_id, {_FLOORS} AS v FROM embeddings WHERE LEN(embedding) = 64 AND {_VALID}),\n"
    + "c0 AS (SELECT CAST(o - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY sha256('2:' || vec_id), vec_id) AS o FROM k) q WHERE o <= 40),\n"
    + ",\n".join(f"{_NEAR.format(i=i)},\n{_MEAN.format(i=i, j=i + 1)}" for i in range(5))
    + f",\n{_NEAR.format(i=5)}\n"
    + "SELECT vec_id, a5.cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256 FROM a5 JOIN k ON k.r = a5.r JOIN c5 ON c5.cluster = a5.cluster"
)

OP13 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_FLOORS} AS c FROM embeddings WHERE label IS NOT NULL AND {_VALID}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS o FROM s WHERE alike) q WHERE o <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_suffix": op2_suffix,
        "op3_decontaminate": op3_decontaminate,
        "op4_toxicity": op4_toxicity,
        "op5_html": op5_html,
        "op6_bpe": op6_bpe,
        "op7_substring": op7_substring,
        "op8_lm": op8_lm,
        "op9_quality": op9_quality,
        "op10_neighbours": op10_neighbours,
        "op11_lines": op11_lines,
        "op12_clusters": op12_clusters,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix": OP2, "op7_substring": OP7, "op11_lines": OP11, "op12_clusters": OP12, "op13_negatives": OP13}
