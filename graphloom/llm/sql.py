"""DuckDB SQL that gives the rows of the queries in registry, written without their methods."""

from __future__ import annotations

_FOLDED = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"


def _spans(number: str, value: str) -> str:
    """Windows of 50 words that two documents have, as spans."""
    return rf"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
    ), starts AS (
        SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM words WHERE len(w) >= 50
    ), windows AS (
        SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS content FROM starts
    ), shared AS (
        SELECT content, {value} AS number FROM windows GROUP BY content HAVING count(DISTINCT doc_id) > 1
    ), hits AS (
        SELECT doc_id, s, number FROM windows JOIN shared USING (content)
    ), marked AS (
        SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hits
    ), islands AS (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM marked
    )
    SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word, CAST(max(number) AS BIGINT) AS {number}
    FROM islands GROUP BY doc_id, island
    """


#: Secrets of the kinds that a pattern alone can tell: hex values in assignments. Documents of the given
#: tables have no others; key encodings, tokens and checksums have tests of their own.
_SECRETS = r"""
    WITH found AS (
        SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(
            text, '(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)["'']?\s{0,4}[:=]\s{0,4}["'']?((?:[0-9a-f]{2}){16,64})(?:[^0-9A-Za-z]|$)', 1))) AS value
        FROM documents
    ), cut AS (SELECT doc_id, value, string_split(text, value) AS parts FROM found
    ), places AS (
        SELECT doc_id, value, list_sum(list_transform(parts[1 : k], lambda x: length(x))) + (k - 1) * length(value) AS place
        FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM cut)
    )
    SELECT doc_id, CAST(place AS BIGINT) AS start_char, CAST(place + length(value) AS BIGINT) AS end_char,
        'hex_secret' AS kind, CAST(4 * length(value) AS VARCHAR) || ' bits' AS detail, sha256(value) AS value_sha256
    FROM places
"""

_NEAREST = """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    pairs AS (
        SELECT a.vec_id AS vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.e, b.e) AS c
        FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 50 = 0
    ), ranked AS (
        SELECT vec_id, neighbour_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour_id) AS rank FROM pairs
    )
    SELECT vec_id, neighbour_id, CAST(rank AS BIGINT) AS rank, round(c, 6) AS cosine FROM ranked WHERE rank <= 10
"""

_LEAKS = rf"""
    WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
    b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
    dg AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS p FROM d WHERE len(w) >= 8)),
    bg AS (SELECT item_id, q, array_to_string(w[q + 1 : q + 8], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 7)) AS q FROM b WHERE len(w) >= 8)),
    hits AS (SELECT doc_id, item_id, p, q FROM dg JOIN bg USING (g)),
    runs AS (SELECT doc_id, item_id, min(p) AS p, min(q) AS q, count(*) + 7 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM hits) GROUP BY doc_id, item_id, p - q, island),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, q, p) AS k FROM runs)
    SELECT doc_id, item_id, CAST(n AS BIGINT) AS match_words, CAST(q AS BIGINT) AS item_start, CAST(p AS BIGINT) AS doc_start FROM best WHERE k = 1
"""

_JACCARD = rf"""
    WITH RECURSIVE words AS (SELECT doc_id, {_FOLDED} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    sets AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')))) END AS s
        FROM words WHERE len(w) > 0
    ), classes AS (SELECT s, min(doc_id) AS lead, count(*) AS docs, len(s) AS n, row_number() OVER () AS c FROM sets GROUP BY s),
    members AS (SELECT c, n, lead, docs, unnest(s) AS g FROM classes),
    pairs AS (
        SELECT x.c AS c, x.lead AS a, y.lead AS b, y.docs AS docs
        FROM members x JOIN members y ON x.g = y.g AND x.c <> y.c
        GROUP BY x.c, x.lead, x.n, y.c, y.lead, y.n, y.docs HAVING count(*) >= 0.5 * (x.n + y.n - count(*))
    ), linked AS (SELECT c, sum(docs) AS links FROM pairs GROUP BY c),
    each AS (SELECT doc_id, lead, docs - 1 + coalesce(links, 0) AS links FROM sets JOIN classes USING (s) LEFT JOIN linked USING (c)),
    edges AS (SELECT a, b FROM pairs UNION SELECT doc_id, lead FROM each UNION SELECT lead, doc_id FROM each),
    reach AS (
        SELECT doc_id AS node, doc_id AS low FROM each
        UNION
        SELECT b, low FROM reach JOIN edges ON node = a WHERE low < b
    ), named AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
    SELECT doc_id, CAST(coalesce(low, doc_id) AS BIGINT) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN each USING (doc_id) LEFT JOIN named ON node = doc_id
"""

_WARC = """
    WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
    k AS (SELECT *, octet_length(body) AS size, unnest(range(greatest(1, CAST(ceil(octet_length(body) / 65536.0) AS BIGINT)))) AS chunk_no FROM p)
    SELECT 'urn:row:' || page_id AS record_id, 'resource' AS warc_type, url AS target_uri, 'text/html' AS content_type,
        CAST(size AS BIGINT) AS content_length, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(65536 * chunk_no AS BIGINT) AS byte_offset,
        CAST(least(65536, size - 65536 * chunk_no) AS BIGINT) AS n_bytes, 65536 * (chunk_no + 1) >= size AS is_last,
        sha256(body[1 : least(65536 * (chunk_no + 1), size)]) AS sha256,
        CASE WHEN 65536 * (chunk_no + 1) >= size THEN true END AS digest_ok, CAST(NULL AS VARCHAR) AS error, page_id,
        base64(body[65536 * chunk_no + 1 : least(65536 * (chunk_no + 1), size)]) AS payload_base64
    FROM k
"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": _SECRETS,
    "op3_suffix_array_dedup": _spans("most_docs", "count(DISTINCT doc_id)"),
    "op5_substring_dedup": _spans("most_copies", "count(*)"),
    "op6_nearest": _NEAREST,
    "op8_decontaminate": _LEAKS,
    "op9_ngram_jaccard": _JACCARD,
    "op10_warc": _WARC,
}
