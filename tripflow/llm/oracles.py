"""The same questions as DuckDB SQL, for those operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base32: five hexadecimal digits are four characters.
_OP3 = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), groups AS (
    SELECT payload, strlen(payload) AS payload_bytes, min(page_id) AS first, sha1(payload) AS hex
    FROM payloads GROUP BY payload
), digests AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1
    )), '') AS payload_digest
    FROM groups
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM payloads JOIN digests USING (payload)
"""

_OP7 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(role) + length(text)
        + len(regexp_extract_all(role || text, '\\|<\||</?s>|\[/?INST\]')) + 23 AS chars
    FROM turns
), read AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
    sha256(learned) AS loss_sha256, formatted_chars
FROM read
"""

_OP10 = rf"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), seen AS (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM docs, (SELECT DISTINCT k FROM windows))
), met AS (
    SELECT DISTINCT r, i, k, item_id FROM seen JOIN windows USING (k, words)
), hits AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""

_OP11 = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        list_dot_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

# Orders are made by joining the letters; a document's fate comes from its place in each.
_OP12 = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), firsts AS (
    SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1
), flags AS (
    SELECT doc_id, max(quality = 1) AS is_good, max(toxic = 1) AS is_toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
        regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
        coalesce(is_good, false) AS is_good, coalesce(is_toxic, false) AS is_toxic
    FROM words JOIN firsts USING (t) LEFT JOIN flags USING (doc_id)
), cells AS (
    SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END,
        CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END,
        CASE WHEN e THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, count(*) FILTER (is_good) AS good, count(*) FILTER (is_toxic) AS toxic
    FROM failed GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT part, filter_order, step, fails, n, good, toxic, contains(fails, filter_order[step]) AS now,
        regexp_matches(fails, concat('[-', filter_order[1:step - 1], ']')) AS gone
    FROM cells, orders, (SELECT unnest(range(1, 6))::INT AS step)
), summed AS (
    SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT now), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND now), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND now), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = filter_order[step]), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND now), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT gone AND now), 0)::BIGINT AS toxic_lost
    FROM steps GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM summed
"""

_OP13 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), seen AS (
    SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS words
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)
), earliest AS (
    SELECT words, (min((coalesce(doc_id, 9223372036854775807), i))) AS first, count(*) AS n FROM seen GROUP BY words
), marks AS (
    SELECT r, i FROM seen JOIN earliest USING (words)
    WHERE n > 1 AND (coalesce(doc_id, 9223372036854775807), i) > first
), gone AS (
    SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM marks) GROUP BY r
), kept AS (
    SELECT doc_id, w, CASE WHEN places IS NULL THEN w
        ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(places, p)), lambda p: w[p])
        END AS k
    FROM docs LEFT JOIN gone USING (r)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed,
    sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

ORACLES: dict[str, str] = {
    "op3_zip_warc": _OP3, "op7_chat_formatting": _OP7, "op10_decontamination": _OP10,
    "op11_hard_negatives": _OP11, "op12_filter_audit": _OP12, "op13_substring_dedup": _OP13,
}
