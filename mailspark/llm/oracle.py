"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS span
    FROM sized, unnest(range(1, len(w) - n + 2)) AS t(j)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS span
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(j)
),
found AS (SELECT doc_id, item_id, p.n, j FROM places p JOIN windows x ON x.n = p.n AND x.span = p.span),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(j, j + n)) AS t(k) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM r a JOIN r c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
placed AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n USING (anchor_id)
    WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 10
""",
}
