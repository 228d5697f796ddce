"""DuckDB SQL for the queries of ``queries.py`` that SQL can express on whole tables."""

_ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)

SECRETS = f"""
WITH rules(rank, kind, pattern, grp, least) AS (
    VALUES (0, 'assign', '{_ASSIGN}', 2, 8), (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)
), texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
    SELECT row_id, 0 AS rank, least, kind, regexp_extract_all(text, '{_ASSIGN}', 0) AS hits,
        regexp_extract_all(text, '{_ASSIGN}', 2) AS vals, regexp_split_to_array(text, '{_ASSIGN}') AS gaps
    FROM texts, rules WHERE rank = 0
    UNION ALL
    SELECT row_id, 1, least, kind, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0),
        regexp_split_to_array(text, 'AKIA[A-Z0-9]+')
    FROM texts, rules WHERE rank = 1
    UNION ALL
    SELECT row_id, 2, least, kind, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0),
        regexp_split_to_array(text, '[0-9a-f]+')
    FROM texts, rules WHERE rank = 2 AND regexp_matches(text, '[0-9a-f]{{32}}')
), numbered AS (
    SELECT row_id, rank, kind, least, gaps, hits, vals, unnest(generate_series(1, len(hits))) AS i FROM found
), spans AS (
    SELECT row_id, rank, kind,
        sum(length(gaps[i]) + coalesce(length(hits[i - 1]), 0)) OVER (PARTITION BY row_id, rank ORDER BY i) AS start_at,
        length(hits[i]) AS width, length(vals[i]) >= least AS counts
    FROM numbered
), kept AS (
    SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
        count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || start_at::BIGINT || ':' || (start_at + width)::BIGINT, ',' ORDER BY start_at, rank) AS spans
    FROM spans WHERE counts GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN kept USING (row_id)
"""

# Base 32 of a digest: its 160 bits, five at a time.
ARCHIVES = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
    SELECT hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(
        list_transform(range(5), lambda j: CAST(substr(bits, (5 * i + j + 1)::INT, 1) AS INT) * (16 >> j::INT))))::INT, 1)), '') AS digest
    FROM (SELECT hex, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(
        (instr('0123456789abcdef', substr(hex, i::INT, 1)) - 1)::INT), 4, '0')), '') AS bits FROM (SELECT DISTINCT hex FROM hashed))
), firsts AS (
    SELECT hex, min(page_id) AS original FROM hashed GROUP BY hex
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM hashed JOIN digests USING (hex) JOIN firsts USING (hex)
"""

_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

AUDIT = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS terms
    FROM documents
), uses AS (
    SELECT row_id, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term FROM uses GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS uses FROM uses JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(n, 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang)
        LEFT JOIN (SELECT lang, source, sum(uses) AS n FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
    SELECT lang, source, term, coalesce(uses, 0) AS uses, 1 + (1000000000 * (coalesce(uses, 0) + 5)) // (n + 5 * v) AS p
    FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), wholes AS (
    SELECT lang, term, 1 + (1000000000 * (sum(uses)::HUGEINT + 5)) // (n + 5 * v) AS q
    FROM counts JOIN (SELECT lang, any_value(v) AS v, sum(n)::HUGEINT AS n FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term, n, v
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
        FROM shares AS x JOIN shares AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) AS d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
), found AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares JOIN wholes USING (lang, term) WHERE uses > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _clustering(rounds: int) -> str:
    """The rounds written out one after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""assigned{i} AS MATERIALIZED (
    SELECT row_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT row_id, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM kept AS k, centroids{i} AS m) GROUP BY row_id)""")
        if i < rounds:
            steps.append(f"""centroids{i + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(moved.v, m.v) AS v FROM centroids{i} AS m LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (
            SELECT c, j, sum(x) AS s, count(*) AS n FROM (
                SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept JOIN assigned{i} USING (row_id)
            ) GROUP BY c, j) GROUP BY c) AS moved ON moved.c = m.c)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY key, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS key, v FROM kept ORDER BY key, v LIMIT 16)
), {", ".join(steps)}, final AS (
    SELECT vec_id, c, d, sum(d) OVER (PARTITION BY c) AS mine, sum(d) OVER () AS whole FROM assigned{rounds} JOIN kept USING (row_id)
)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, mine::BIGINT AS cluster_inertia, whole::BIGINT AS inertia,
    sha256(array_to_string(v, ',')) AS centroid_sha256
FROM final JOIN centroids{rounds} USING (c)
"""


ORACLES = {
    "op1_secret_scan": SECRETS, "op7_warc": ARCHIVES, "op11_source_audit": AUDIT, "op12_centroids": _clustering(3),
}
