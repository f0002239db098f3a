"""DuckDB SQL for the queries that SQL can express, written on its own."""

from __future__ import annotations

from tallyweave.llm.licenses import NOTICES

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op3_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

SQL["op6_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
    SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score
    FROM c q JOIN c r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

SQL["op8_license_scan"] = """
WITH t AS (SELECT * FROM (VALUES {notices}) AS t(license_id, body)),
tw AS (SELECT license_id, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM t),
ts AS (SELECT DISTINCT license_id, len(w) AS n, greatest(1, len(w) // 4) AS step, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM tw),
tc AS (SELECT license_id, count(*) AS total FROM ts GROUP BY 1),
d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT doc_id, md5(text) AS version, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM d),
ds AS (
    SELECT doc_id, version, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM dw WHERE len(w) >= 5),
hit AS (SELECT * FROM ds JOIN ts USING (s)),
win AS (SELECT doc_id, version, license_id, s, step, unnest(range(greatest(0, pos - (n - 4)) // step, pos // step + 1)) AS k FROM hit),
found AS (SELECT doc_id, version, license_id, k * step AS start, count(DISTINCT s) AS n_found FROM win GROUP BY ALL),
best AS (
    SELECT * FROM found JOIN tc USING (license_id) WHERE 100 * n_found >= 80 * total
    QUALIFY row_number() OVER (PARTITION BY doc_id, version, license_id ORDER BY n_found DESC, start) = 1)
SELECT doc_id, license_id, total::BIGINT AS n_shingles, n_found::BIGINT AS n_found, start::BIGINT AS start FROM best
""".format(notices=", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in NOTICES))

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32 = " || ".join(
    f"substr('{LETTERS}', ((('0x' || substr(h, {1 + 10 * part}, 10))::BIGINT >> {shift}) & 31)::INTEGER + 1, 1)"
    for part in range(4)
    for shift in range(35, -1, -5)
)

SQL["op10_warc_round_trip"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM h
"""

TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(t)) AS n, u AS term, count(*) AS tf FROM (SELECT *, unnest(t) AS u FROM d) GROUP BY r, u),
size AS (SELECT DISTINCT r, n FROM held),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM size),
freq AS (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term),
item AS (SELECT row_number() OVER () AS i, item_id, {TERMS} AS t FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT i, item_id, u AS term, count(*)::BIGINT AS times FROM (SELECT *, unnest(t) AS u FROM item) GROUP BY ALL),
gain AS (
    SELECT r, doc_id, held.term,
        floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS g
    FROM held JOIN freq USING (term), whole),
scored AS (
    SELECT i, item_id, r, doc_id, sum(times * g)::BIGINT AS score FROM wanted JOIN gain USING (term) GROUP BY ALL HAVING sum(times * g) > 0)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored
QUALIFY rank <= 20
"""

ASSIGN = r'''([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'''


def _places(name: str, pattern: str, value: str) -> str:
    """r, start, stop and value of the matches of a pattern: gaps and matches take turns."""
    return f"""{name}_all AS (
    SELECT r, i, list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)::BIGINT AS start, hits[i] AS hit
    FROM (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))),
{name} AS (SELECT r, start, start + length(hit) AS stop, hit, {value} AS value FROM {name}_all)"""


SQL["op13_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
{_places("assigned", ASSIGN, f"regexp_extract(hit, '{ASSIGN}', 2)")},
{_places("access", "AKIA[A-Z0-9]+", "hit")},
{_places("hex", "[0-9a-f]{16,}", "hit")},
{_places("run", "[A-Za-z0-9+/_.=-]{12,}", "hit")},
base AS (
    SELECT r, 0 AS kind, start, stop, value FROM assigned WHERE length(value) >= 12
    UNION ALL SELECT r, 1, start, stop, value FROM access WHERE length(value) >= 18
    UNION ALL SELECT r, 2, start, stop, value FROM hex),
bare AS (
    SELECT r, 3 AS kind, start + length(value) - length(ltrim(value, '+/_.=-')) AS start, start + length(rtrim(value, '+/_.=-')) AS stop, trim(value, '+/_.=-') AS value FROM run),
kept AS (
    SELECT * FROM bare WHERE length(value) >= 12 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = bare.r AND base.start < bare.stop AND bare.start < base.stop)),
candidate AS (
    SELECT r, kind, start, stop, trim(value, '+/_.=-') AS token, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND CASE WHEN kind < 3 THEN len(list_distinct(string_split(value, ''))) >= 8
            ELSE regexp_full_match(value, '[A-Za-z0-9+=_-]{{20,}}') AND len(list_distinct(string_split(value, ''))) >= 10 AND len(regexp_extract_all(value, '[0-9]+')) >= 4
                AND NOT regexp_full_match(value, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}') END AS live
    FROM (SELECT * FROM base UNION ALL SELECT * FROM kept)),
owned AS (
    SELECT token, count(DISTINCT coalesce('=' || source, '')) AS n_owners, bool_or(kind < 2 AND live) AS named FROM candidate JOIN d USING (r) GROUP BY token),
judged AS (SELECT *, n_owners <= 2 AS own, kind = 3 AND n_owners <= 2 AND (named OR live) AS added FROM candidate JOIN owned USING (token)),
spans AS (
    SELECT r, start, stop, CASE WHEN kind < 3 THEN kind WHEN named THEN 3 ELSE 4 END AS kind, CASE WHEN kind = 3 THEN added ELSE own AND live END AS live, NOT own AS wide
    FROM judged WHERE kind < 3 OR added),
named AS (SELECT *, ['assign', 'access', 'hex', 'reuse', 'bare'][kind + 1] || ':' || start || ':' || stop AS s FROM spans),
per AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) AS n_spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (wide) AS n_examples,
        string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples
FROM d LEFT JOIN per USING (r)
"""
