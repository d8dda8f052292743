"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_W = r"[^\x20\x09-\x0D]+"
_LUHN = "list_sum(list_transform(string_split(reverse(g), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0"
_PLAIN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: (CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END) % 97) = 1"
_BANK = "iban|bank|account|konto|compte|cuenta"
#: Pattern, what makes a match valid, points and context words.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 70, "mail|contact|kontakt|correo|courriel"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 1000) > 255)) = 0", 60, "host|server|address|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length(g) BETWEEN 12 AND 19 AND {_LUHN}", 90, "card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15", 60, "phone|call|mobile|fax|telefon"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", _MOD97, 90, _BANK),
    "account": ("[0-9]+", "length(g) BETWEEN 8 AND 17", 40, f"{_BANK}|kunde"),
    "secret": ("[A-Za-z0-9+/_=-]{20,}", "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')", 40, "token|secret|password|passwd|api.?key|access.?key|credential"),
}
_sum = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
_hit = lambda p: f"regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS p"
_at = f"list_transform(range(1, len(h) + 1), lambda i: {_sum('p[1:i]')} + {_sum('h[1:i-1]')})"
_has = lambda words: f"regexp_matches(near, '(?i){words}')"
_found = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS k, {n} AS r, st AS s, st + length(v) AS e, greatest(0, least(100, {points} + CASE WHEN {_has(words)} THEN 30 ELSE 0 END - CASE WHEN {_has('example|sample|version|isbn|checksum|commit')} THEN 40 ELSE 0 END)) AS score
FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS g, substring(t, greatest(st - 39, 1)::BIGINT, least(st, 40)::BIGINT) AS near FROM (SELECT doc_id, t, unnest({_at}) AS st, unnest(h) AS v FROM (SELECT doc_id, t, {_hit(pat)} FROM d))) WHERE {ok}"""
    for n, (k, (pat, ok, points, words)) in enumerate(_PII.items())
)
_BASE = list(_PII)[:4]
_join = lambda what, also="": f"string_agg({what}, ',' ORDER BY s, r){also}"

ORACLE = {
    "op3_personal_data": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT *, k || ':' || s || ':' || e AS line FROM ({_found}) WHERE r < 4 OR score >= 60),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in _BASE)}, {_join('line', ' FILTER (r < 4)')} AS base, {_join('line')} AS spans, {_join('score::VARCHAR')} AS scores FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op5_nn_descent": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = id""",
    "op6_mixing": rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS p FROM w),
v AS (SELECT arg_min(lvl, p) FILTER (lvl <= cap / w) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM l, v),
c AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS ep FROM c)
SELECT doc_id, size, source_size, target, (ep * size + greatest(0, least(size, floor(target)::BIGINT - ep * source_size - before)))::BIGINT AS taken FROM e""",
    "op7_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS b, sha1(coalesce(html, '')) AS d FROM pages), t AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to FROM p LEFT JOIN t ON t.d = p.d""",
    "op8_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' #' || len(w)] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN s p ON p.doc_id = o.a JOIN s q ON q.doc_id = o.b WHERE 100 * both_ >= 80 * (len(p.s) + len(q.s) - both_)),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON id = doc_id""",
}

_NEAREST = "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(v.x, w.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k v, c{n} w) GROUP BY rid"
_FLOOR = "(s - ((s % n) + n) % n) // n"
_ROUND = f"""a{{n}} AS MATERIALIZED ({_NEAREST}), m{{n}} AS (SELECT c, list({_FLOOR} ORDER BY i)::BIGINT[] AS x FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS i FROM a{{n}} JOIN k USING (rid)) GROUP BY c, i) GROUP BY c),
c{{m}} AS MATERIALIZED (SELECT c, coalesce(m{{n}}.x, c{{n}}.x) AS x FROM c{{n}} LEFT JOIN m{{n}} USING (c))"""
ORACLE["op12_heap_clustering"] = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM k QUALIFY c < 40),
{', '.join(_ROUND.format(n=n, m=n + 1) for n in range(5))}, f AS MATERIALIZED ({_NEAREST.format(n=5)})
SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM f JOIN k USING (rid) JOIN c5 ON c5.c = f.c"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE["op11_ranked_search"] = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents), g AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, sum(len(ts))::BIGINT AS ll FROM d),
p AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nn),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)), m AS (SELECT rid, doc_id, 50 + (50 * len(ts)::BIGINT * nn) // ll AS m FROM d, g),
s AS (SELECT item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s JOIN m USING (rid) WHERE score > 0 QUALIFY rank <= 50"""

ORACLE["op13_suffix_dedup"] = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, s, md5(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(len(h) // 2 - 199)) AS s FROM d)),
c AS (SELECT rid, s FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS run FROM (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT rid, min(s) AS s, max(s) + 200 AS e FROM g GROUP BY rid, run), l AS (SELECT rid, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, count(*) AS n, sum(e - s) AS gone FROM r GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(n + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * es[i] + 1 END, CASE WHEN i = n THEN len(h) ELSE 2 * (ss[i + 1] - CASE WHEN i = 0 THEN 0 ELSE es[i] END) END)), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (rid)"""
