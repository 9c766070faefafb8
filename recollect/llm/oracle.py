"""DuckDB SQL that states the registered queries another way."""

from __future__ import annotations

from recollect.llm.imatch import RATES, subset_factors

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d)
), hit AS (
  SELECT rid, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), word AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), marked AS (
  SELECT word.rid, i, word, max(hit.s) OVER (PARTITION BY word.rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS last
  FROM word LEFT JOIN hit ON hit.rid = word.rid AND hit.s = i
), kept AS (
  SELECT rid, count(*) FILTER (i - last < 35) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 35) AS text
  FROM marked GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT rid, doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
), k AS (
  SELECT *, CASE WHEN length(t) >= 20 THEN translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS k FROM l
), g AS (
  SELECT k, max(doc_id) AS keeper FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT rid, k.doc_id, i, line, coalesce(k.doc_id <> keeper, FALSE) AS gone FROM k LEFT JOIN g ON g.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""

OP3 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(url[strpos(url, '://') + 3:], '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(rest, '/') THEN rest[strpos(rest, '/'):] ELSE '' END AS path FROM u
), r AS (
  SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, h, p, verdict)
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, 'spam|pills|casino|porn|xxx') OR contains(path, 'free-download') OR contains(path, '/login')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (page_id)
"""

_SUBSETS = ", ".join(f"({j}, {a}, {b}, {rate})" for j, ((a, b), rate) in enumerate(zip(subset_factors(), RATES, strict=True), 1))
OP4 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (
  SELECT a.r, b.r AS next, a.doc_id, length(a.t) AS n, a.t, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS changed
  FROM d a JOIN d b ON b.r = a.r % (SELECT count(*) FROM d) + 1
), k AS (SELECT r, 0 AS kind, t FROM e UNION ALL SELECT r, 1, changed FROM e
), w AS MATERIALIZED (
  SELECT DISTINCT r, kind, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM k
), term AS MATERIALIZED (
  SELECT w, CAST('0x' || left(h, 6) AS BIGINT) AS slot, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS v FROM (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM w))
), band AS (
  SELECT slot FROM w JOIN term USING (w) WHERE kind = 0 GROUP BY slot
  HAVING count(*) >= pow((SELECT count(*) FROM d), 1 - 0.9) AND count(*) <= pow((SELECT count(*) FROM d), 1 - 0.15)
), f(j, a, b, rate) AS (VALUES {_SUBSETS}
), lies AS MATERIALIZED (
  SELECT w, v, kept, unnest(list_prepend(0, js)) AS j FROM (
    SELECT term.w, v, band.slot IS NOT NULL AS kept, coalesce(js, []) AS js FROM term LEFT JOIN band USING (slot)
    LEFT JOIN (SELECT slot, list(j) AS js FROM (SELECT DISTINCT slot FROM term) s JOIN f ON (s.slot * a + b) % 2147483647 % rate = 0 GROUP BY slot) USING (slot))
), held AS (SELECT DISTINCT r, kind FROM w JOIN lies USING (w) WHERE kept AND j = 0
), sig AS (
  SELECT r, kind, j, CAST(sum(v) % 4294967296 AS BIGINT) AS h
  FROM w JOIN lies USING (w) LEFT JOIN held USING (r, kind) WHERE kept OR held.r IS NULL GROUP BY r, kind, j
), grid AS MATERIALIZED (
  SELECT g.r, g.kind, g.j, coalesce(h, 0) AS h FROM (SELECT r, kind, unnest(range(0, {len(RATES) + 1})) AS j FROM k) g LEFT JOIN sig USING (r, kind, j)
), p AS MATERIALIZED (SELECT r, kind, string_agg(format('{{:08x}}', h), ' ' ORDER BY j) AS print, list(h ORDER BY j) AS hs FROM grid GROUP BY r, kind
), beside AS (
  SELECT e.*, p0.print AS own, p1.print AS edited, list_zip(p0.hs, p1.hs)[2:] AS z1, list_zip(p0.hs, p2.hs)[2:] AS z0, p2.print AS after
  FROM e JOIN p p0 ON p0.r = e.r AND p0.kind = 0 JOIN p p1 ON p1.r = e.r AND p1.kind = 1 JOIN p p2 ON p2.r = e.next AND p2.kind = 0
)
SELECT doc_id, n AS n_chars, sha256(changed) AS edited_sha256, own AS fingerprint, edited AS edited_fingerprint,
  CASE WHEN own = edited THEN 1.0 ELSE len(list_filter(z1, lambda x: x[1] = x[2] AND x[1] <> 0)) / greatest(1, len(list_filter(z1, lambda x: x[1] <> 0 OR x[2] <> 0))) END AS near_edited,
  CASE WHEN own = after THEN 1.0 ELSE len(list_filter(z0, lambda x: x[1] = x[2] AND x[1] <> 0)) / greatest(1, len(list_filter(z0, lambda x: x[1] <> 0 OR x[2] <> 0))) END AS near_next
FROM beside
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), e2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e
), r AS (SELECT x AS doc_id, x AS reach FROM (SELECT DISTINCT x FROM e2) UNION SELECT r.doc_id, e2.y FROM r JOIN e2 ON e2.x = r.reach
), c AS (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP11 = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM lowered),
a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY item_id, t
), v AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a WHERE t IN (SELECT t FROM q)
), s AS (
  SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN v USING (t) JOIN p USING (t) JOIN d USING (r), a GROUP BY item_id, doc_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
# the given pages have one template, whose <article> is the article; "&amp" may lack its ";"
OP12 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&amp;', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM b),
e AS (SELECT page_id, url, trim(regexp_replace(t, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), w AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY lang, t HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.t, CAST(coalesce(x.n, 0) AS BIGINT) AS n, k.n AS whole
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, t, sum(n) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.t = k.t
), s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT c.lang, c.source, c.t, c.n, CAST(1 + 1000000000 * (c.n + 2)::HUGEINT // (s.total + 2 * v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + 1000000000 * (whole + 2)::HUGEINT // (l.total + 2 * v)::HUGEINT AS BIGINT) AS q
  FROM c JOIN s USING (lang, source) JOIN l ON l.lang = c.lang
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op2_line_dedup": OP2, "op3_url_filter": OP3, "op4_fingerprints": OP4, "op5_ngram_jaccard_join": OP5, "op11_ranked_search": OP11, "op12_html_extract": OP12, "op13_source_divergence": OP13}
