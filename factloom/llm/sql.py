"""SQL twins (DuckDB) of the queries that SQL can express."""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        cut AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
        keyed AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
        shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        told AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM told GROUP BY doc_id""",
    "op3_warc": """
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        bits AS (SELECT page_id, strlen(body) AS payload_bytes, hex,
                        array_to_string([format('{:04b}', instr('0123456789abcdef', c) - 1) for c in string_split(hex, '')], '') AS b FROM hashed),
        told AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
                        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT
                          + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1) for i in range(32)], '') AS payload_digest
                 FROM bits)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM told""",
    "op13_url_filters": """
        WITH rules (h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        best AS (SELECT d.host, d.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
                 FROM (SELECT DISTINCT host, path FROM parts) d
                 JOIN rules r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p) GROUP BY ALL)
        SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""",
    "op12_phrase_collocations": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
        cut AS (SELECT lang, [x for x in string_split_regex(piece, '[ \t]+') if x <> ''] AS w FROM pieces),
        sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM cut),
        placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k),
        f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        some_ AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE f >= 30 AND k > 1),
        cuts AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS c FROM some_),
        scored AS (SELECT s.lang, s.phrase, s.k, s.a, min(struct_pack(score := ((2000000::HUGEINT * s.a) // (x.f + y.f))::BIGINT, c := s.c, l := x.f, r := y.f)) AS cut
                   FROM cuts s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:s.c], ' ')
                   JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[s.c + 1:], ' ') GROUP BY ALL),
        ins AS (SELECT lang, a, w, k, unnest(range(2, k)) AS z FROM some_ WHERE k > 2),
        inside AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
                   FROM (SELECT *, unnest(range(1, k - z + 2)) AS i FROM ins) GROUP BY ALL),
        left_ AS (SELECT s.lang, s.phrase, s.a, s.cut.l AS l, s.cut.r AS r, s.cut.score AS score
                  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
                  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
