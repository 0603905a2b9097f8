"""DuckDB SQL for those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .license import BASE_PHRASES, DRIFT, SHARE, TEMPLATES, K

_URL = r"""
WITH rules(rule, host, path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
own(name, pattern) AS (VALUES
  ('casino-host', '(?i)^[^/]*\bcasino\b[^/]*'), ('porn-host', '(?i)^[^/]*\bporn\b[^/]*'), ('ads-path', '(?i)^[^/]*/([^/]*/)*ads/'),
  ('login-page', '(?i)/login(\.[a-z]+)?$'), ('cart-page', '(?i)/cart/checkout\b'), ('feed-file', '(?i)/feed\.xml$')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
pos AS (SELECT page_id,
  translate(CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut)
SELECT page_id, a.host AS host, a.path AS path,
  (SELECT arg_max(r.rule, length(r.rule)) FROM rules r WHERE (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.rule)) FROM rules r WHERE (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)),
    CASE WHEN EXISTS (SELECT 1 FROM own o WHERE regexp_matches(a.host || a.path, o.pattern)) THEN 'block' ELSE 'allow' END) AS verdict
FROM pos a
"""

_TOPK = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256.0 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_CHAT = """
SELECT conv_id, turn, 'message' AS kind, 0 AS idx, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, turn AS place, 0 AS level,
  CAST(to_json({'content': text, 'role': role, 'turn': turn}) AS VARCHAR) AS json
FROM conversations WHERE NOT (role IN ('assistant', 'tool') AND starts_with(ltrim(text), '{'))
"""

_SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, hash(list_slice(words, i, i + 19)) AS a, md5(array_to_string(list_slice(words, i, i + 19), ' ')) AS b FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM p),
g AS (SELECT DISTINCT doc_id, i + d AS i FROM f, unnest(range(0, 20)) AS t(d) WHERE n > 1),
l AS (SELECT doc_id, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
k AS (SELECT l.doc_id, string_agg(l.word, ' ' ORDER BY l.i) AS kept, count(*) AS n FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def _license() -> str:
    """Own labels by brute force: chains of meetings grow one by one, forward in text and template, and all
    of a chain's diagonals lie within the drift of its first and in one run of near diagonals."""
    grams = []
    for kind, pairs in (("base", BASE_PHRASES.items()), ("own", ((v, k) for k, v in TEMPLATES.items()))):
        for text, label in pairs:
            words = text.split(" ")
            grams += [f"('{kind}', '{label}', '{text}', {len(words)}, {j}, '{' '.join(words[j : j + K])}')" for j in range(len(words) - K + 1)]
    return r"""
WITH RECURSIVE t(kind, label, template, m, j, gram) AS (VALUES %(grams)s),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT doc_id, i - 1 AS i, array_to_string(list_slice(words, i, i + %(k)d - 1), ' ') AS gram FROM w, unnest(range(1, len(words) - %(k)d + 2)) AS r(i)),
e AS MATERIALIZED (SELECT doc_id, kind, label, template, m, i, j, i - j AS d FROM g JOIN t USING (gram)),
b AS (SELECT doc_id, label, d AS start FROM e WHERE kind = 'base' GROUP BY doc_id, label, template, m, d HAVING count(*) = m - %(k)d + 1),
n AS MATERIALIZED (SELECT doc_id, label, template, m, i, j, d, CAST(greatest(%(drift)d, m // 2) AS INTEGER) AS drift FROM e WHERE kind = 'own'),
f AS (SELECT DISTINCT doc_id, template, d FROM n),
p AS MATERIALIZED (SELECT n.* FROM n SEMI JOIN (SELECT doc_id, template FROM n GROUP BY 1, 2, m HAVING count(DISTINCT j) >= %(share)s * (m - %(k)d + 1)) USING (doc_id, template)),
c(doc_id, template, low, i, j, d, size) AS (
  SELECT doc_id, template, lo.d, p.i, p.j, p.d, 1 FROM p JOIN f lo USING (doc_id, template) WHERE p.d BETWEEN lo.d AND lo.d + p.drift
    AND NOT EXISTS (SELECT 1 FROM f a WHERE a.doc_id = p.doc_id AND a.template = p.template AND a.d >= lo.d AND a.d < p.d AND NOT EXISTS (SELECT 1 FROM f z WHERE z.doc_id = a.doc_id AND z.template = a.template AND z.d > a.d AND z.d <= a.d + %(drift)d))
  UNION
  SELECT c.doc_id, c.template, c.low, p.i, p.j, p.d, c.size + 1 FROM c JOIN p ON p.doc_id = c.doc_id AND p.template = c.template AND p.i > c.i AND p.j > c.j AND p.d BETWEEN c.low AND c.low + p.drift
    AND NOT EXISTS (SELECT 1 FROM f a WHERE a.doc_id = p.doc_id AND a.template = p.template AND a.d >= c.low AND a.d < p.d AND NOT EXISTS (SELECT 1 FROM f z WHERE z.doc_id = a.doc_id AND z.template = a.template AND z.d > a.d AND z.d <= a.d + %(drift)d))),
o AS (SELECT doc_id, any_value(q.label) AS label, CAST(max(size) AS DOUBLE) / (any_value(q.m) - %(k)d + 1) AS hit FROM c JOIN (SELECT DISTINCT label, template, m FROM t WHERE kind = 'own') q USING (template) GROUP BY doc_id, template),
x AS (SELECT doc_id, label, start, 1.0 AS hit FROM b UNION ALL SELECT doc_id, label, NULL, hit FROM o WHERE hit >= %(share)s),
s AS (SELECT doc_id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (start IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(hit) AS score FROM x GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM w LEFT JOIN s ON w.doc_id = s.doc_id
""" % {"grams": ", ".join(grams), "k": K, "drift": DRIFT, "share": SHARE}


_PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k FROM w, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a FROM f WHERE k > 1 AND f >= 30),
o AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 80 * x.a),
u AS (SELECT c.*, j, array_to_string(list_slice(string_split(phrase, ' '), 1, j), ' ') AS x, array_to_string(list_slice(string_split(phrase, ' '), j + 1, k), ' ') AS y
  FROM c ANTI JOIN o USING (lang, phrase), unnest(range(1, k)) AS s(j)),
v AS (SELECT u.lang AS lang, u.phrase AS phrase, a, j, fx.f AS l, fy.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(fx.f AS HUGEINT) + fy.f) AS BIGINT) AS score
  FROM u JOIN f fx ON fx.lang = u.lang AND fx.phrase = u.x AND fx.k = j JOIN f fy ON fy.lang = u.lang AND fy.phrase = u.y AND fy.k = u.k - j),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM v),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT q.lang AS lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""

#: Over code points rather than units: a unit ends where a letter does not follow a letter.
_FIM = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
m AS (SELECT doc_id, text, length(text) AS chars, h, regexp_replace(regexp_replace(text, '[^A-Za-z]', '0', 'g'), '[A-Za-z]', '1', 'g') AS mask FROM t),
e AS (SELECT doc_id, text, chars, h, list_filter(range(1, chars + 1), lambda i: mask[i] = '0' OR i = chars OR mask[i + 1] = '0') AS ends FROM m),
d AS (SELECT *, len(ends) AS n, list_transform(range(0, 4), lambda g: list_reduce(list_transform(string_split(substr(h, CAST(8 * g + 1 AS INTEGER), 8), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: 16 * a + b)) AS v FROM e),
c AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE ends[a] END AS i, CASE WHEN b = 0 THEN 0 ELSE ends[b] END AS j FROM c),
y AS (SELECT *, substr(text, 1, i) AS head, substr(text, i + 1, j - i) AS mid, substr(text, j + 1, chars - j) AS tail FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM y
"""

ORACLES: dict[str, str] = {
    "op3_url_filter": _URL,
    "op6_topk": _TOPK,
    "op7_chat_format": _CHAT,
    "op8_license_scan": _license(),
    "op10_substring_dedup": _SUBSTRING,
    "op11_collocations": _PHRASES,
    "op13_fill_in_middle": _FIM,
}
