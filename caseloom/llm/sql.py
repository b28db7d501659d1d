"""DuckDB SQL for those queries of this subpackage that SQL can express. Learning, template shares and tokenising have none."""

from __future__ import annotations

from .secrets import BASE, MORE

_SPACES = r"[\x20\x09-\x0D]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Components of the pairs lk(a, b) with a < b: the smallest node reachable, for nodes with a link.
_COMPONENTS = "bo AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc(a, c) AS (SELECT a, a FROM bo UNION SELECT bo.b, rc.c FROM rc JOIN bo ON rc.a = bo.a WHERE rc.c < bo.b), cm AS (SELECT a, min(c) AS c FROM rc GROUP BY 1)"

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS ss FROM w),
  e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS n, any_value(y.n) AS m FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  lk AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (n + m - k)), {_COMPONENTS}
  SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN cm ON doc_id = a"""

DECONTAMINATION = rf"""WITH d AS (SELECT 0 AS t, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
  w AS (SELECT t, id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM d),
  s AS (SELECT t, id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) AS ss FROM w WHERE len(ws) >= 5), i AS (SELECT min(id) AS id, list_sort(ss) AS ss FROM s WHERE t = 1 GROUP BY 2),
  q AS (SELECT id AS item_id, len(ss) AS n, unnest(ss) AS g FROM i), h AS (SELECT id AS doc_id, unnest(ss) AS g FROM s WHERE t = 0)
  , b AS (SELECT min(id) AS item_id, array_to_string(ws, ' ') AS few FROM w WHERE t = 1 AND len(ws) BETWEEN 1 AND 4 GROUP BY 2)
  SELECT doc_id, item_id, count(*) AS n_shared, CAST(any_value(n) AS BIGINT) AS n_item, count(*) / any_value(n) AS containment FROM h JOIN q USING (g) GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n)
  UNION ALL SELECT id, item_id, 1, 1, 1.0 FROM w JOIN b ON t = 0 AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || few || ' ')"""

SUBSTRINGS = rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)), f AS (SELECT k, min(doc_id) AS low FROM g GROUP BY 1),
  c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM g JOIN f USING (k) WHERE doc_id > low)), r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY 1)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""

ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), lk AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98), {_COMPONENTS}
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM v LEFT JOIN cm ON vec_id = cm.a LEFT JOIN (SELECT a, count(*) AS n FROM bo GROUP BY 1) k ON vec_id = k.a"""

#: The driver's pages hold no canonical links or refresh redirects, so its classes are single urls.
URLS = r"""WITH h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
  r(kind, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
  b AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(kind, length(rh || rp)) AS own FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
  SELECT page_id, host, path, rule, coalesce(own, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)"""

#: Distinct words at one edit: one is the other without a code point, or both without the same place are equal. crc32 is a fold over the bytes (two for each letter beyond ASCII).
SPELLING = rf"""WITH RECURSIVE cr(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM cr WHERE k < 8), tb AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM cr WHERE k = 8),
  r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents), o AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY 1, 2),
  h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM o, tb),
  d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h), v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  x AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
  p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON less = v.word UNION SELECT v.word, x.word FROM x JOIN v ON less = v.word),
  q AS (SELECT p.word, count(*) AS n_near, min({{'l': -v.n, 'near': near}}) AS best FROM p JOIN v ON near = v.word GROUP BY 1),
  f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.l >= 5 * n THEN best.near END AS form, CASE WHEN -best.l >= 5 * n THEN -best.l END AS form_n FROM v LEFT JOIN q USING (word)),
  u(word, root) AS (SELECT word, word FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON u.root = f.word WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, u.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN u USING (word) JOIN f z ON u.root = z.word WHERE z.form IS NULL"""

LINES = f"""WITH l AS (SELECT doc_id, i, lines[i] AS line, trim(translate(lines[i], {_AZ}), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
  c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < last) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id >= last), '')) AS kept_sha256 FROM l LEFT JOIN c USING (k) GROUP BY 1"""

_NEAREST = "SELECT r, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, p.part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {book} b ON p.part = b.part) GROUP BY 1, 2, 3"
_MOVED = "b{i} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{before} b LEFT JOIN (SELECT part, entry, list(c ORDER BY pos) AS c FROM (SELECT part, entry, pos, CAST(floor(sum(v[pos]) / count(*)) AS BIGINT) AS c FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS pos FROM ({nearest})) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry))"
CODES = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM e, range(8) t(part)), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= 16),
  {", ".join(_MOVED.format(i=i, before=i - 1, nearest=_NEAREST.format(book=f"b{i - 1}")) for i in range(1, 7))},
  o AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({_NEAREST.format(book="b6")}) GROUP BY 1)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256 FROM e JOIN o USING (r)"""


#: Rules in a form without possessive parts and looks behind, which DuckDB lacks and does not need.
PLAIN = {"jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"}


def _rule(order: int) -> str:
    rule = (BASE + MORE)[order]
    regex = PLAIN.get(rule.kind, rule.regex).replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, CAST(pos AS BIGINT) AS s, CAST(pos + length(m[i]) AS BIGINT) AS e FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{regex}') AS g, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {rule.group}) AS v FROM d))) WHERE length(m[i]) >= {rule.least} AND length(v[i]) >= {rule.group_least}"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(_rule(i) for i in range(len(BASE + MORE)))}),
  a AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM s GROUP BY 1)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
