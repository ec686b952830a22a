"""SQL (DuckDB) for the queries of this package that SQL can express."""

#: Every order and step is counted from the rows' failures, without a table of counts in between.
FILTER_AUDIT = """
WITH given AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS found
    FROM documents
), lowest AS (SELECT body, min(doc_id) AS low FROM given GROUP BY body
), labelled AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), flagged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(found) < 100,
        'B': 100 * len(list_distinct(found)) < 80 * len(found),
        'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body),
        'D': regexp_matches(body, '[#$%&*|]'),
        'E': coalesce(g.doc_id > low, false)} AS f
    FROM given g JOIN lowest USING (body) LEFT JOIN labelled l ON l.doc_id = g.doc_id
), failed AS (
    SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
        CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n
    FROM flagged GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x) JOIN letter d ON d.x NOT IN (a.x, b.x, c.x)
    JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), places AS (
    SELECT filter_order, step::INT AS step, filter_order[step] AS own, left(filter_order, step - 1) AS earlier
    FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), hit AS (
    SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, fails = own AS alone,
           translate(fails, earlier, '') <> fails AS gone
    FROM failed, places
), counted AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost
    FROM hit GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

#: CRC-32 bit by bit over the decimal digits; trees level by level.
MERKLE = """
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v::BIGINT)) AS crc
), given AS (
    SELECT doc_id, source, lang, n_chars, text,
        xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc
    FROM documents, bits
), hashed AS (
    SELECT doc_id, lang, crc, sha256(concat(
            coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
            coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-'),
            coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
        sha256(concat(
            coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
            coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-'),
            coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS changed
    FROM given
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), low AS (
    SELECT lang, 0 AS level, pos, leaf AS h, n FROM ranked
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n
), tops AS (
    SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT 0 AS level, pos, subroot AS h, n FROM tops
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), start AS (
    SELECT row_number() OVER () AS row, r.doc_id, r.leaf, t.subroot, (SELECT h FROM high WHERE n = 1) AS root, r.lang, r.pos, t.pos AS top, t.height,
        CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS given
    FROM ranked r JOIN tops t ON t.lang IS NOT DISTINCT FROM r.lang
), walk AS (
    SELECT row, lang, top, height, pos AS place, 0 AS level, '' AS proof, given AS folded FROM start
    UNION ALL
    SELECT w.row, w.lang, w.top, w.height, CASE WHEN w.level + 1 = w.height THEN w.top ELSE w.place // 2 END, w.level + 1,
        w.proof || coalesce(s.h, ''), sha256(CASE WHEN w.place % 2 = 1 THEN coalesce(s.h, '') || w.folded ELSE w.folded || coalesce(s.h, '') END)
    FROM walk w LEFT JOIN low s ON w.lang IS NOT DISTINCT FROM s.lang AND s.level = w.level AND s.pos = xor(w.place, 1)
    WHERE w.level < w.height
), crossed AS (
    SELECT row, 0 AS level, top AS place, proof, folded FROM walk WHERE level = height
    UNION ALL
    SELECT c.row, c.level + 1, c.place // 2, c.proof || coalesce(s.h, ''),
        sha256(CASE WHEN c.place % 2 = 1 THEN coalesce(s.h, '') || c.folded ELSE c.folded || coalesce(s.h, '') END)
    FROM crossed c LEFT JOIN high s ON s.level = c.level AND s.pos = xor(c.place, 1)
    WHERE c.level < (SELECT max(level) FROM high)
)
SELECT s.doc_id, s.leaf, s.subroot, s.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = s.root AS verified
FROM start s JOIN crossed c ON c.row = s.row AND c.level = (SELECT max(level) FROM high)
"""
