"""SQL for the corpus queries that it can express, for DuckDB over the same tables."""

from __future__ import annotations

from evidence_engine.llm import license_rules

EXACT_TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

SHARDING = """WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    tbl AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    raw AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
    crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM raw CROSS JOIN tbl),
    run AS (SELECT *, (sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total FROM crc),
    cut AS (SELECT *, least(7, (8 * (2 * upto - size)) // (2 * total))::INTEGER AS shard FROM run)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
    y AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM x)
    SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM y"""


def licenses() -> str:
    """Units by place, merged as relations; then a rule at a time, as long as it matches, by recursion."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"  # noqa: E731
    known = ", ".join(f"({quote(license_rules.normalized(s))}, {quote(i)})" for i, s in license_rules.SENTENCES.items())
    rules = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, seq))}])" for k, (name, seq) in enumerate(license_rules.RULES, 1))
    text, most = "replace(text, chr(13), '')", max(len(seq) for _, seq in license_rules.RULES)
    cut = rf"string_split(regexp_replace(regexp_replace({text}, '([.!?;])[ \t\n\v\f]+', '\1' || chr(1), 'g'), '\n[ \t\n\v\f]*\n', chr(1), 'g'), chr(1))"
    units = lambda split, line: f"SELECT u.uid, i.i, {line} AS line, u.part[i.i] AS part FROM (SELECT uid, {split} AS part FROM d) u, LATERAL (SELECT unnest(range(1, len(u.part) + 1)) AS i) i"  # noqa: E731
    # The place of each identifier of a rule, each behind the one before; null when one is missing.
    places = "".join(f", p{k} AS (SELECT *, CASE WHEN len(seq) < {k} THEN p{k - 1} ELSE p{k - 1} + nullif(list_position(ids[p{k - 1} + 1:], seq[{k}]), 0) END AS p{k} FROM p{k - 1})" for k in range(1, most + 1))
    own = ", ".join(f"p{k}" for k in range(1, most + 1))
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, text FROM documents),
    known(norm, id) AS (VALUES {known}), rules(k, name, seq) AS (VALUES {rules}),
    units AS ({units(cut, 'false')} UNION ALL {units(f"string_split({text}, chr(10))", 'true')}),
    sized AS (SELECT *, length(regexp_replace(part, '[ 	
]', '', 'g')) AS n, trim(regexp_replace(lower(part), '[^a-z0-9.]+', ' ', 'g'), ' .') AS norm FROM units),
    ends AS (SELECT *, sum(n) OVER (PARTITION BY uid, line ORDER BY i) AS e FROM sized),
    hits AS (SELECT uid, line, (e - n)::BIGINT AS a, e::BIGINT AS e, n, id FROM ends JOIN known USING (norm)),
    lines AS (SELECT * FROM hits x WHERE line AND NOT EXISTS (SELECT 1 FROM hits y WHERE y.uid = x.uid AND NOT y.line AND x.a < y.e AND y.a < x.e AND y.n >= x.n)),
    kept AS (SELECT * FROM lines UNION ALL SELECT * FROM hits y WHERE NOT line AND NOT EXISTS (SELECT 1 FROM lines x WHERE x.uid = y.uid AND x.a < y.e AND y.a < x.e)),
    lists AS (SELECT uid, list(id ORDER BY a, e) AS ids FROM kept GROUP BY uid),
    fold(uid, k, ids, names) AS (SELECT uid, 1, ids, []::VARCHAR[] FROM lists UNION ALL (WITH p0 AS (SELECT fold.*, rules.name, rules.seq, 0 AS p0 FROM fold JOIN rules USING (k)){places}
      SELECT uid, CASE WHEN p{most} IS NULL THEN k + 1 ELSE k END, CASE WHEN p{most} IS NULL THEN ids ELSE list_filter(ids, lambda x, i: NOT list_contains([{own}], i)) END,
        CASE WHEN p{most} IS NULL OR list_contains(names, name) THEN names ELSE list_append(names, name) END FROM p{most})),
    done AS (SELECT uid, names FROM fold WHERE k = {len(license_rules.RULES) + 1})
    SELECT doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, '|'), '') AS sentence_ids, coalesce(array_to_string(names, '|'), '') AS licenses FROM d LEFT JOIN lists USING (uid) LEFT JOIN done USING (uid)"""


ORACLE_SQL = {"op1_exact_topk": EXACT_TOPK, "op3_sharding": SHARDING, "op7_warc": WARC, "op10_license_scan": licenses()}
