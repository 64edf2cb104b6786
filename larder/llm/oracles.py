"""DuckDB SQL for the rows of the queries that SQL can express."""

ORACLE = {
    "op4_secrets": r"""
        WITH rules(rank, kind, pattern, grp, least) AS (VALUES
            (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
            (2, 'hex', '[0-9a-f]{24,}', 0, 24),
            (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(-----END [A-Z ]*PRIVATE KEY-----)?', 0, 1),
            (4, 'signed', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
            (5, 'login', '[a-z][a-z0-9+]{1,9}://[^\s/:@]{1,64}:[^\s/:@]{4,64}@', 0, 1)),
        texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        hits AS (
            SELECT doc_id, rank, kind, pattern, grp, least, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps
            FROM texts, rules WHERE regexp_matches(text, pattern)),
        placed AS (
            SELECT doc_id, rank, kind, pattern, grp, least, found[i] AS hit,
                   coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits)),
        spans AS (
            SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop FROM placed
            WHERE length(CASE grp WHEN 2 THEN regexp_extract(hit, pattern, 2) ELSE hit END) >= least),
        told AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
                   string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
            FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN told USING (doc_id)""",
    "op10_mixing": r"""
        WITH own AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5(CAST(doc_id AS VARCHAR)) AS ord FROM documents),
        sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM own GROUP BY source),
        full_at AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1] AS weight FROM sizes),
        levels AS (
            SELECT *, cap / weight AS level,
                   (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS reached
            FROM full_at WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        goals AS (
            SELECT source, source_size, [-0.5::DOUBLE, 0.0, 0.5][rank % 3 + 1] AS slope,
                   least(cap, coalesce(max(reached) FILTER (reached <= level) OVER (), level) * weight) AS target FROM levels),
        placed AS (
            SELECT o.doc_id, o.size, g.source_size, g.target, g.slope, CAST(floor(g.target) AS BIGINT) AS words,
                   CAST(coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.ord, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM own o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source),
        reads AS (
            SELECT *, least(greatest(words - start, 0), size) AS first, least(greatest(words - start - source_size, 0), size) AS second FROM placed),
        shares AS (
            SELECT *, CASE WHEN first > 0 THEN (start + first / 2.0::DOUBLE) / target END AS u, CASE WHEN second > 0 THEN (start + source_size + second / 2.0::DOUBLE) / target END AS v FROM reads)
        SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken,
               CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END AS position,
               CASE WHEN slope = 0 THEN v ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * v) - (1 - slope)) / (2 * slope) END AS again
        FROM shares""",
}
