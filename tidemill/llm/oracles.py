"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

#: Exact deduplication: equal normalised texts, the smallest doc_id stays.
OP6 = r"""
WITH norm AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       text_sha256
FROM norm
WINDOW same AS (PARTITION BY text_sha256)
"""

#: Chat formatting: a conversation stays if none that is longer begins with it, and, among equal ones, no smaller id.
OP4 = r"""
WITH turns AS (
    SELECT conv_id,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
           sha256(concat(coalesce('+' || role, '-'), chr(1), coalesce('+' || sha256(text), '-'))) AS h,
           '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS piece
    FROM conversations
), lists AS (
    SELECT conv_id, list(h ORDER BY pos) AS hs, count(*) AS n_turns, string_agg(piece, '' ORDER BY pos) AS text
    FROM turns GROUP BY conv_id
), prefixes AS (
    SELECT DISTINCT array_to_string(list_slice(hs, 1, k), ',') AS p
    FROM lists, LATERAL (SELECT unnest(range(1, n_turns)) AS k)
)
SELECT min(conv_id) AS conv_id, n_turns, text
FROM lists
WHERE array_to_string(hs, ',') NOT IN (SELECT p FROM prefixes)
GROUP BY hs, n_turns, text
"""

#: Line deduplication: keys of 40 code points in 5 documents stay in the last document that holds them.
OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT y.*, o.k IS NOT NULL AND y.doc_id IS DISTINCT FROM o.last AS gone FROM keyed y LEFT JOIN often o ON y.k = o.k)
GROUP BY r, doc_id
"""

#: Filter audit: masks of failures counted for each part, then each order's steps from the masks.
OP13 = r"""
WITH masks AS (
    SELECT coalesce(lang, '') AS part, doc_id,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM (SELECT lang, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), judged AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM masks LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
    JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
    SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::BIGINT AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
    SELECT part, filter_order, step::INTEGER AS step, bit,
           coalesce(sum(n) FILTER (WHERE mask & (before + bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM steps, cells GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

def _op12(rounds: int = 4) -> str:
    """Code compression: Lloyd rounds written out, every part against every entry. Doubles hold these integers exactly."""
    steps = [
        """ints AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM ints, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
    SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
        SELECT x.r, x.p, b.e, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS d
        FROM parts x JOIN book{k} b USING (p)
    ) GROUP BY r, p
)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
        SELECT p, e, list(x ORDER BY dim) AS v FROM (
            SELECT p, e, dim, floor(sum(x) / count(*)) AS x
            FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS dim FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, dim
        ) GROUP BY p, e
    ) m USING (p, e)
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f""", digest AS (
    SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, dim)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS dim FROM book{rounds})
), coded AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM near{rounds} JOIN ints USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""
    )


ORACLES: dict[str, str] = {
    "op4_chat_format": OP4,
    "op6_exact_dedup": OP6,
    "op11_line_dedup": OP11,
    "op12_code_compression": _op12(),
    "op13_filter_audit": OP13,
}
