"""DuckDB SQL of the operators that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
RUN = "[A-Za-z0-9+/_=-]{20,}"
SECRETS = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT * FROM (VALUES ('assign', 0), ('access', 1), ('hex', 2), ('entropy', 3)) v(kind, rank)),
    f AS (SELECT doc_id, kind, rank,
            CASE rank WHEN 0 THEN regexp_split_to_array(t, '{ASSIGN}') WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]{{16,}}') WHEN 2 THEN regexp_split_to_array(t, '[0-9a-f]{{24,}}') ELSE regexp_split_to_array(t, '{RUN}') END AS gaps,
            CASE rank WHEN 0 THEN regexp_extract_all(t, '{ASSIGN}') WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]{{16,}}') WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]{{24,}}') ELSE regexp_extract_all(t, '{RUN}') END AS found,
            CASE rank WHEN 0 THEN regexp_extract_all(t, '{ASSIGN}', 1) END AS val FROM d, p),
    s AS (SELECT doc_id, kind, rank, found[k] AS hit, val[k] AS v, (list_sum([length(x) FOR x IN gaps[1 : k]]) + coalesce(list_sum([length(x) FOR x IN found[1 : k - 1]]), 0))::BIGINT AS a FROM f, unnest(range(1, len(found) + 1)) u(k)),
    b AS (SELECT doc_id, kind, rank, a, a + length(hit) AS z FROM s WHERE rank = 0 AND length(v) >= 6 OR rank IN (1, 2)),
    w AS (SELECT doc_id, a, hit, i, CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 3.0 WHEN regexp_full_match(hit, '[A-Z0-9+/_=-]+') THEN 3.4 ELSE 3.7 END AS bits, substr(hit, i, 20) AS x
          FROM s, unnest(range(1, length(hit) - 18)) u(i)
          WHERE rank = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
          AND NOT regexp_matches(hit, '(?i)example|sample|placeholder|xxxx') AND NOT regexp_matches(hit, '^sha(1|256|384|512)-') AND NOT regexp_matches(hit, '^[0-9/_+=-]*[A-Za-z]{{1,3}}[0-9/_+=-]*$')),
    h AS (SELECT *, log2(20) - list_avg([log2(20 - length(replace(x, c, ''))) FOR c IN string_split(x, '')]) AS e FROM w),
    e AS (SELECT doc_id, 'entropy' AS kind, 3 AS rank, a + min(i) - 1 AS a, a + max(i) + 19 AS z FROM h WHERE e >= bits GROUP BY doc_id, h.a, hit),
    n AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.a <= e.a AND e.z <= b.z)),
    g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM b GROUP BY doc_id),
    y AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM n) GROUP BY doc_id)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(g.spans, '')) AS base_sha256, coalesce(y.spans, '') AS spans FROM d LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id)"""

_PLACES = [pow(16807, i + 1, 2147483647) for i in range(64)]
RULES = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT r, i, ws[i] AS word FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d), unnest(range(1, len(ws) + 1)) u(i)),
    u AS (SELECT word, list_sum(list_transform(regexp_extract_all(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.'), lambda c, j: unicode(c)::BIGINT * {_PLACES}[(j - 1) % 64 + 1] % 2147483647))::BIGINT % 2147483647 AS h FROM (SELECT DISTINCT word FROM p)),
    g AS MATERIALIZED (SELECT r, i, h FROM p JOIN u USING (word)),
    b AS MATERIALIZED (SELECT r, h * 40692 % 2147483647 % 65536 AS b FROM g UNION ALL SELECT x.r, (x.h * 69621 + y.h * 48271) % 2147483647 % 65536 FROM g x JOIN g y ON y.r = x.r AND y.i = x.i + 1),
    ok AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
    raw AS (SELECT b, count(*) AS n FROM b GROUP BY b), good AS (SELECT b, count(*) AS n FROM b JOIN d USING (r) JOIN ok USING (doc_id) GROUP BY b),
    share AS (SELECT coalesce((SELECT sum(n) FROM good), 0)::DOUBLE / greatest((SELECT sum(n) FROM raw), 1)::DOUBLE AS s),
    w AS (SELECT raw.b, floor(ln((coalesce(good.n, 0) + 8.0::DOUBLE) / (raw.n * s + 8.0::DOUBLE)) * 65536 + 0.5)::BIGINT AS w FROM raw LEFT JOIN good USING (b), share),
    s AS (SELECT r, count(*) AS n, sum(w)::BIGINT AS w FROM b JOIN w USING (b) GROUP BY r),
    k AS (SELECT x.r, x.i, count(*) OVER (PARTITION BY x.r, x.word, y.word, z.word) AS n FROM p x JOIN p y ON y.r = x.r AND y.i = x.i + 1 JOIN p z ON z.r = x.r AND z.i = x.i + 2),
    m AS (SELECT r, count(DISTINCT i + j) AS n FROM k, unnest(range(0, 3)) v(j) WHERE n > 1 GROUP BY r),
    l AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
    c AS (SELECT r, count(*) AS n, sum(length(word))::BIGINT AS chars FROM p GROUP BY r),
    f AS (SELECT doc_id, coalesce(c.n, 0) AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words,
          coalesce(s.n, 0) AS n_grams, coalesce(s.w, 0) AS score FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r) LEFT JOIN s USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND score >= floor(-0.12 * 65536 + 0.5)::BIGINT * n_grams AS kept FROM f"""

TRIE = r"""
    WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS r, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda t, z: xor(t >> 1, (t & 1) * 3988292384))), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
    b AS (SELECT c.conv_id, 0 AS part, r, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND r <= h UNION ALL SELECT conv_id, 1, r, role, text FROM o JOIN c USING (conv_id) WHERE r > h),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d FROM b),
    k AS MATERIALIZED (SELECT conv_id, d, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, len(regexp_extract_all(text, '[^ 	-
]+')) AS w, d = max(d) OVER (PARTITION BY conv_id) AS last FROM t
          UNION ALL SELECT conv_id, 0, '', 0, NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = c.conv_id) FROM c),
    n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM k GROUP BY d, k),
    q AS MATERIALIZED (SELECT n.*, u.k AS up FROM n LEFT JOIN k u ON u.conv_id = n.conv_id AND u.d = n.d - 1),
    e AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM q WHERE d > 0 GROUP BY 1, 2),
    a AS (SELECT y.d, y.k, count(*) FILTER (kids IS NULL) AS leaves, sum((n - 1) * q.w)::BIGINT AS saved FROM q LEFT JOIN e ON e.d = q.d AND e.k = q.k JOIN k y ON y.conv_id = q.conv_id AND y.d <= q.d GROUP BY y.d, y.k)
    SELECT q.conv_id, q.d AS depth, p.conv_id AS parent_conv_id, q.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(q.ends) AS ends_sha256
    FROM q LEFT JOIN n p ON p.d = q.d - 1 AND p.k = q.up LEFT JOIN e ON e.d = q.d AND e.k = q.k JOIN a ON a.d = q.d AND a.k = q.k"""


def centroids(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """Lloyd's rounds, a pair of subqueries each."""
    near = "SELECT r, v.q, c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, {} m QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE) AND abs(x) <= 131072)) = {dim})",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(f'm{i}')})")
        parts.append(f"s{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j)::BIGINT[] AS q FROM (SELECT c, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, {dim + 1})) u(j) GROUP BY c, j) GROUP BY c)")
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(s.q, m.q) AS q FROM m{i} m LEFT JOIN s{i} s ON s.c = m.c)")
    return f"""WITH {", ".join(parts)}, f AS MATERIALIZED ({near.format(f"m{rounds}")})
        SELECT vec_id, f.c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY f.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
        FROM f JOIN v USING (r) JOIN m{rounds} m ON m.c = f.c"""


SQL = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) WHERE len(ws) > 0),
        s AS (SELECT DISTINCT n FROM g),
        h AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM d, s, unnest(range(1, len(ws) - n + 2)) t(i)),
        m AS (SELECT h.doc_id, h.i, h.n, g.item_id FROM h JOIN g USING (n, k)),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, n)) t(j) GROUP BY doc_id),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op3_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) t(i)),
        m AS (SELECT h, min(doc_id) AS f FROM k GROUP BY h),
        c AS (SELECT DISTINCT k.doc_id, i + j AS i FROM k JOIN m USING (h), unnest(range(0, 50)) t(j) WHERE f < k.doc_id),
        p AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
        q AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN q USING (doc_id)""",
    "op5_secrets": SECRETS,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
        d AS (SELECT page_id, strlen(h) AS n, first_id, sha1(h) AS x FROM p JOIN f USING (h))
        SELECT page_id, n AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
        CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM d""",
    "op11_centroids": centroids(),
    "op12_rules": RULES,
    "op13_trie": TRIE,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
