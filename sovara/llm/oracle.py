"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN translate(regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS rn
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE rn = 1
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (SELECT id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'p': i, 'w': words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2]}}), recursive := true) FROM d),
counted AS (SELECT id, p, count(*) OVER (PARTITION BY id, w) AS n FROM windows),
covered AS (SELECT id, count(DISTINCT q) AS n_repeat_words FROM (SELECT id, unnest([p, p + 1, p + 2]) AS q FROM counted WHERE n > 1) GROUP BY id),
m AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN lines USING (id) LEFT JOIN covered USING (id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(32))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(32))) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT s.doc_id, len(s.s) AS n_shingles, c.c AS component_id FROM s JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) c ON c.v = s.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN c ON c.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT id, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, length(x) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT id, p, CASE WHEN p - lag(p) OVER (PARTITION BY id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE doc_id > m),
r AS (SELECT id, k, min(p) AS a, max(p) + 50 AS b FROM (SELECT id, p, sum(new) OVER (PARTITION BY id ORDER BY p) AS k FROM g) GROUP BY id, k),
q AS (SELECT id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY a) AS z FROM r),
t AS (SELECT id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM q JOIN d USING (id) GROUP BY id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (id)
"""

_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF('text')} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF('text')} END AS seen FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
t AS (SELECT 0 AS l, g, i, h, m FROM p UNION ALL SELECT l + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (m + 7) // 8 FROM t WHERE m > 1 GROUP BY l, g, i // 8, m),
s AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (SELECT 1000 AS l, i, h, m FROM s UNION ALL SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (m + 7) // 8 FROM u WHERE m > 1 GROUP BY l, i // 8, m),
n AS (
  SELECT p.g, p.i, t.l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i >> (3 * t.l)), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i >> (3 * t.l)), '') AS b
  FROM p JOIN t ON t.g = p.g AND t.m > 1 AND t.i >> 3 = p.i >> (3 * t.l + 3) GROUP BY ALL
  UNION ALL SELECT p.g, p.i, u.l, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.i >> (3 * (u.l - 1000))), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.i >> (3 * (u.l - 1000))), '')
  FROM p JOIN s USING (g) JOIN u ON u.m > 1 AND u.i >> 3 = s.i >> (3 * (u.l - 1000) + 3) GROUP BY ALL),
w AS (SELECT g, i, string_agg(a || b, '' ORDER BY l) AS sides, list({{'a': a, 'h': '', 'b': b}} ORDER BY l) AS steps FROM n GROUP BY g, i)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(sides, '')) AS proof_sha256,
  list_reduce(list_prepend({{'a': '', 'h': p.seen, 'b': ''}}, coalesce(steps, [])), lambda x, y: {{'a': '', 'h': sha256(y.a || x.h || y.b), 'b': ''}}).h AS folded_root, folded_root = r.h AS verified
FROM p JOIN (SELECT g, h FROM s) s USING (g) LEFT JOIN w USING (g, i), (SELECT h FROM u WHERE m = 1) r
"""

SQL = {"op13_merkle_manifest": MERKLE, "op10_suffix_dedup": SUFFIX_DEDUP, "op3_embedding_dedup": EMBEDDING_DEDUP, "op2_ngram_jaccard": NGRAM_JACCARD, "op5_url_filter": URL_FILTER, "op8_quality_rules": QUALITY_RULES}
