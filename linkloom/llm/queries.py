"""Queries of this subpackage by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from linkloom.llm import bpe, html, lm, near_dup, packing, quality, sharding, toxicity, urls, vectors

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_url_filters": urls.op4_url_filters,
    "op5_embedding_near_dup": vectors.op5_embedding_near_dup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: Components by reach: each node's least node over chains of links, for tables small enough to join their links with themselves.
_COMPONENTS = "rch AS (SELECT id AS a, id AS b FROM nd UNION SELECT r.a, l.b FROM rch r JOIN lk l ON l.a = r.b), cmp AS (SELECT a AS id, min(b) AS component_id FROM rch GROUP BY a)"
_BOTH = "lk AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)"

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dup": "WITH RECURSIVE nd AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),"
    " ok AS (SELECT * FROM nd WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),"
    " one AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),"
    f" {_BOTH}, {_COMPONENTS}, n AS (SELECT a AS id, count(*) AS n_links FROM lk GROUP BY a)"
    " SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM cmp LEFT JOIN n USING (id)",
    "op7_near_dup": r"WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),"
    " nd AS (SELECT id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w), sh AS (SELECT id, unnest(s) AS g FROM nd),"
    " pr AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM sh x JOIN sh y ON x.g = y.g AND x.id < y.id GROUP BY ALL),"
    " one AS (SELECT a, b FROM pr JOIN nd x ON x.id = a JOIN nd y ON y.id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),"
    f" {_BOTH}, {_COMPONENTS} SELECT id AS doc_id, len(s) AS n_shingles, component_id, id = component_id AS kept FROM cmp JOIN nd USING (id)",
}
