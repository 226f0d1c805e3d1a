"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, context_tree, fingerprints, media, mixing, ngram_join, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_context_tree": context_tree.op4_context_tree,
    "op5_warc": warc.op5_warc,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_media": media.op7_media,
    "op8_quality": quality.op8_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM g),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS p FROM m, range(0, 13) t(k) WHERE first_id < doc_id),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_warc": warc.OP5_SQL,
    "op10_ngram_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
half AS MATERIALIZED (SELECT x, y FROM both_of JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
link AS MATERIALIZED (SELECT x, y FROM half UNION SELECT y, x FROM half),
reach(a, b) AS (SELECT x, y FROM link UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id, n""",
}
