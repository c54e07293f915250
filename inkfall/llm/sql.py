"""DuckDB SQL with the rows of those queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '[', '[\'), '<', '<\')"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(4 + length({_ESCAPED}) + CASE role WHEN 'user' THEN 6 WHEN 'system' THEN 5 WHEN 'assistant' THEN 5 ELSE 7 + length(role) END))::bigint AS formatted_chars
FROM turns GROUP BY conv_id
"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT rep, rep FROM classes UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
least_of AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, len(d.s)::bigint AS n_shingles, coalesce(l.c, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes k ON k.s = d.s LEFT JOIN least_of l ON l.x = k.rep
"""

SUBSTRING = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS tag, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT r, doc_id, tag, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20 AND doc_id IS NOT NULL),
windows AS (SELECT r, doc_id, tag, i, hash(array_to_string(w[i:i + 19], ' ')) AS h, md5(array_to_string(w[i:i + 19], ' ')) AS m FROM starts),
repeated AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY h, m ORDER BY doc_id, tag, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT r, i + j AS i FROM repeated, range(0, 20) t(j)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (g.i IS NOT NULL) AS removed, string_agg(word, ' ' ORDER BY words.i) FILTER (g.i IS NULL) AS text
  FROM words LEFT JOIN gone g USING (r, i) GROUP BY r
)
SELECT d.doc_id, coalesce(k.n, 0)::bigint AS n_words, coalesce(k.removed, 0)::bigint AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::varchar)) || ':' || {0}::varchar END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""

MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE ':' || source END AS grp, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM docs),
nodes AS (
  SELECT grp, 0 AS lvl, idx, n, leaf AS node FROM leaves
  UNION ALL SELECT grp, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, idx // 16, n
),
subroots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, idx, n, subroot AS node FROM subroots
  UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM uppers WHERE n > 1 GROUP BY lvl, idx // 16, n
),
steps AS (
  SELECT grp, 0 AS part, lvl, idx, n, coalesce(string_agg(node, '') OVER b, '') AS bef, coalesce(string_agg(node, '') OVER a, '') AS aft
  FROM nodes WINDOW b AS (PARTITION BY grp, lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY grp, lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  UNION ALL
  SELECT '', 1, lvl, idx, n, coalesce(string_agg(node, '') OVER b, ''), coalesce(string_agg(node, '') OVER a, '')
  FROM uppers WINDOW b AS (PARTITION BY lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
folds AS (
  SELECT r, grp, 0 AS part, 0 AS lvl, idx, n, coalesce(changed, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT f.r, f.grp, CASE WHEN f.n = 1 THEN 1 ELSE f.part END, CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN f.n = 1 THEN u.idx ELSE f.idx // 16 END, CASE WHEN f.n = 1 THEN u.n ELSE (f.n + 15) // 16 END,
    CASE WHEN f.n = 1 THEN f.node ELSE sha256(s.bef || f.node || s.aft) END, CASE WHEN f.n = 1 THEN f.proof ELSE f.proof || s.bef || s.aft END
  FROM folds f JOIN subroots u ON u.grp = f.grp JOIN steps s ON s.part = f.part AND s.grp = CASE WHEN f.part = 0 THEN f.grp ELSE '' END AND s.lvl = f.lvl AND s.idx = f.idx
  WHERE f.n > 1 OR f.part = 0
)
SELECT l.doc_id, l.leaf, s.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN folds f ON f.r = l.r AND f.part = 1 AND f.n = 1, (SELECT node FROM uppers WHERE n = 1) t
"""

NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::bigint AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, positive_id, positive_score ORDER BY score DESC, vec_id) AS k, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, k::int AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
