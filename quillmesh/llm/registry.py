"""Registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, digest, jaccard, langid, packing, pii, sharding, suffixarray, suffixtree, topk


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_pii": pii.op3_pii,
        "op4_sharding": sharding.op4_sharding,
        "op5_suffixarray": suffixarray.op5_suffixarray,
        "op6_packing": packing.op6_packing,
        "op7_topk": topk.op7_topk,
        "op8_langid": langid.op8_langid,
        "op9_suffixtree": suffixtree.op9_suffixtree,
        "op10_digest": digest.op10_digest,
    }


#: Sets of shingles, pairs at the threshold, and the smallest document that each reaches.
JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
 SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s"""

TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def oracle_sql() -> dict:
    """For the two that SQL expresses in reasonable time; the tests hold the others against brute force."""
    return {"op2_jaccard": JACCARD_SQL, "op7_topk": TOPK_SQL}
