"""DuckDB SQL for the operators that SQL can express; each works from the contract, not from the operator's method."""

WORD = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
s AS (SELECT doc_id, w, p, CASE WHEN count(*) OVER f = 20 THEN string_agg(w, ' ') OVER f END AS s FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS rep FROM s),
c AS (SELECT *, coalesce(max(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

CONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {PLAIN}) AS ws FROM benchmark WHERE item_id IS NOT NULL),
ph AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[p : p + 9], ' ') AS s FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {PLAIN}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
t AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM w),
tw AS MATERIALIZED (SELECT t.doc_id, t.p, k.n, array_to_string(t.ten[1 : k.n], ' ') AS s FROM t CROSS JOIN (SELECT DISTINCT n FROM ph) k WHERE len(t.ten) >= k.n),
h AS (SELECT tw.doc_id, tw.p, tw.n, ph.item FROM tw JOIN ph ON ph.s = tw.s AND ph.n = tw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORD}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p, len(ws) AS n FROM d),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, n, count(*) OVER f AS c, p, string_agg(w, ' ') OVER f AS s FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5 OR (n < 5 AND p = 0)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT l.a, l.b FROM l JOIN k x ON x.doc_id = l.a JOIN k y ON y.doc_id = l.b WHERE 100 * l.c >= 85 * (x.n + y.n - l.c)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT id, min(seen) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept FROM d LEFT JOIN k ON k.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    q = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n, vals[i] AS v
FROM (SELECT doc_id, source, string_split_regex(text, '{q}') AS gaps, regexp_extract_all(text, '{q}') AS hits, regexp_extract_all(text, '{q}', {group}) AS vals, unnest(range(1, len(regexp_extract_all(text, '{q}')) + 1)) AS i FROM t) WHERE length(vals[i]) >= {least}"""


def secrets_sql(base: dict, wider: tuple, owners: int, repositories: int) -> str:
    """SQL for the secret report with the given base patterns, the wider one, and the owners and repositories of a live value at most."""
    spans = " UNION ALL ".join(_spans(kind, rank, *rule) for rank, (kind, rule) in enumerate(base.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}" for kind in base)
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS ({spans}),
o AS (SELECT w.* FROM ({_spans(wider[0], len(base), *wider[1:])}) w WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND b.a < w.a + w.n AND w.a < b.a + b.n)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM o),
own AS (SELECT v, count(DISTINCT source) > {owners} OR count(DISTINCT CASE WHEN source IS NOT NULL THEN source || ':' || doc_id ELSE ':' || doc_id END) > {repositories} AS copied FROM c GROUP BY 1),
j AS (SELECT c.*, own.copied, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM c JOIN own ON own.v = c.v WHERE kind <> '{wider[0]}' OR NOT copied),
g AS (SELECT doc_id, {counts}, coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (kind <> '{wider[0]}'), '') AS base, string_agg(s, ',' ORDER BY a, rank) AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_example FROM j GROUP BY 1)
SELECT t.doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM t LEFT JOIN g ON g.doc_id = t.doc_id
"""
