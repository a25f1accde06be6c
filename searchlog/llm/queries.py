"""Registered queries of the operators and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from searchlog.llm.bpe import op1_bpe
from searchlog.llm.conversations import op13_conversations
from searchlog.llm.decontaminate import op10_decontaminate
from searchlog.llm.embeddings import op5_embeddings
from searchlog.llm.lines import op8_lines
from searchlog.llm.lm import op6_lm
from searchlog.llm.negatives import op11_negatives
from searchlog.llm.pages import op12_pages
from searchlog.llm.quality import op7_quality
from searchlog.llm.secrets import op4_secrets
from searchlog.llm.simhash import op3_simhash
from searchlog.llm.substrings import op2_substrings
from searchlog.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_substrings": op2_substrings,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_embeddings": op5_embeddings,
    "op6_lm": op6_lm,
    "op7_quality": op7_quality,
    "op8_lines": op8_lines,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_negatives": op11_negatives,
    "op12_pages": op12_pages,
    "op13_conversations": op13_conversations,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS gram
            FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 34)) AS i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n FROM windows) WHERE n > 1),
removed AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS place FROM repeated),
each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
         FROM each ANTI JOIN removed USING (doc_id, place) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op5_embeddings": """
WITH RECURSIVE e AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
          ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
smallest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM smallest LEFT JOIN counts USING (vec_id)""",
    "op10_decontaminate": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bs AS (SELECT item_id, words, least(13, len(words)) AS size FROM bw WHERE len(words) > 0),
grams AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS gram
          FROM bs, LATERAL (SELECT unnest(generate_series(1, len(words) - size + 1)) AS i)),
sizes AS (SELECT DISTINCT size FROM grams),
found AS (SELECT w.doc_id, p.i, s.size, g.item_id
          FROM w, sizes s, LATERAL (SELECT unnest(generate_series(1, len(w.words) - s.size + 1)) AS i) p
          JOIN grams g ON g.size = s.size AND g.gram = array_to_string(w.words[p.i:p.i + s.size - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit
           FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w.words), false) AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_negatives": """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                  CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5""",
    "op13_conversations": """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- a byte comes in by exclusive or, -1 stands for one of its eight shifts
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
           xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                   lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
    FROM turns GROUP BY conv_id),
plan AS (SELECT c.conv_id, c.n, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS head FROM crc c LEFT JOIN crc b ON b.conv_id = c.base),
rebuilt AS (
    SELECT p.conv_id, place AS depth, role, text FROM plan p JOIN turns t ON t.conv_id = p.base AND place <= h
    UNION ALL
    SELECT conv_id, place - h + head, role, text FROM plan JOIN turns USING (conv_id) WHERE place > h),
way AS (
    SELECT conv_id, depth, strlen(text) AS size,
           string_agg(md5(concat(length(role), ':', role, ':', text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
nodes AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM way GROUP BY key),
parents AS (SELECT n.key, w.key AS parent FROM nodes n JOIN way w ON w.conv_id = n.conv_id AND w.depth = n.depth - 1),
children AS (SELECT parent AS key, count(*) AS n_children FROM parents GROUP BY parent),
subtree AS (
    SELECT w.key, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (WHERE c.key IS NULL) AS leaves
    FROM nodes n JOIN way w ON w.conv_id = n.conv_id AND w.depth <= n.depth LEFT JOIN children c ON c.key = n.key GROUP BY w.key),
ends AS (
    SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(key, depth) AS key FROM way GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN subtree USING (key) LEFT JOIN children USING (key) LEFT JOIN ends USING (key)
LEFT JOIN parents USING (key) LEFT JOIN nodes u ON u.key = parents.parent""",
}
