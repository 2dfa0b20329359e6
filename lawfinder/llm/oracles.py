"""SQL with the rows of those queries that SQL can express; it compares all pairs, so it is for small tables."""

from .neardup import THRESHOLD as ALIKE
from .neardup import WORDS

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS j FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= {ALIKE}),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links, min(CASE WHEN j = 1 THEN b END) AS copy FROM l GROUP BY a)
SELECT c.doc_id, least(c.doc_id, coalesce(copy, c.doc_id)) AS copy_of, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k USING (doc_id)
"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
    WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


def _round(n: int) -> str:
    """Codes by the codebooks of round ``n``, and the codebooks of the next one."""
    off = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return (
        f"d{n} AS (SELECT vec_id, part, entry, {off} AS off FROM p JOIN b{n} b USING (part)), a{n} AS (SELECT vec_id, part, min(off) AS off, min_by(entry, off * 64 + entry) AS entry FROM d{n} GROUP BY vec_id, part), "
        f"s{n} AS (SELECT part, entry, i, CAST(floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS c FROM a{n} JOIN p USING (vec_id, part), range(1, w + 1) t(i) GROUP BY part, entry, i), "
        f"b{n + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS v FROM s{n} GROUP BY part, entry) m USING (part, entry))"
    )


OP12 = (
    "WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), "
    "p AS (SELECT vec_id, label, CAST(part AS INTEGER) AS part, len(x) // 16 AS w, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS v FROM k, range(16) t(part)), "
    "b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)), "
    f"{_round(0)}, {_round(1)}, {_round(2)}, "
    "f AS (SELECT vec_id, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(off) AS BIGINT) AS error FROM a2 GROUP BY vec_id), "
    "h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2) "
    "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h"
)
