"""SQL that must give the same rows as the queries, for DuckDB over the same tables."""

from __future__ import annotations

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def tok(column: str) -> str:
    return TOK.format(column)


DOC_TOKENS = f"d AS (SELECT doc_id, unnest({tok('text')}) AS tok FROM documents)"
QUESTIONS = f"q AS (SELECT item_id, {tok('text')} AS toks, text AS query, text FROM benchmark)"
TERMS = "qt AS (SELECT item_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest(toks) AS tok FROM q) GROUP BY item_id, tok)"


def bm25(tokens: str = DOC_TOKENS, name: str = "bm", k: int = 20) -> str:
    """CTEs up to name(query_id, segment_id, score, rank)."""
    return f"""{tokens}, {QUESTIONS}, {TOKENS_OF_TERMS}, {name} AS (
    SELECT * FROM (SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
        SELECT qt.item_id AS query_id, tf.doc_id AS segment_id, sum(qt.qtf * ln(1 + (nn.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 1.2)) AS score
        FROM tf JOIN qt USING (tok) JOIN df USING (tok) CROSS JOIN nn GROUP BY 1, 2) WHERE score > 0) WHERE rank <= {k})"""


TOKENS_OF_TERMS = TERMS + """,
    tf AS (SELECT doc_id, tok, count(*) AS tf FROM d WHERE tok IN (SELECT tok FROM qt) GROUP BY doc_id, tok),
    df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), nn AS (SELECT count(*) AS n FROM documents)"""

OVERLAP = """ov AS (SELECT * FROM (SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
    SELECT qt.item_id AS query_id, tf.doc_id AS segment_id, count(*)::DOUBLE / any_value(qn.n) AS score FROM tf JOIN qt USING (tok) JOIN (SELECT item_id, count(*) AS n FROM qt GROUP BY item_id) qn ON qn.item_id = qt.item_id GROUP BY 1, 2)) WHERE rank <= 20)"""


def unit(source: str = "embeddings", where: str = "true") -> str:
    return f"(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM {source} WHERE {where})"


def dense(name: str, corpus: str, queries: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
    SELECT b.vec_id AS query_id, a.vec_id AS segment_id, list_dot_product(a.v, b.v) AS score FROM {unit(where=corpus)} a CROSS JOIN {unit(where=queries)} b)) WHERE rank <= {k})"""


HOURS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - 1704067200000000 AS us, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS h FROM events)"
VIDEOS = "vid AS (SELECT user_id, max(h) AS duration FROM e GROUP BY user_id HAVING max(h) > 0)"
WINDOWS = f"""{HOURS}, {VIDEOS}, w AS (SELECT user_id AS video_id, printf('%d_%04d', user_id, i) AS segment_id, i, round(i * 15.0::DOUBLE, 3) AS start_time, round(least(i * 15.0::DOUBLE + 20, duration), 3) AS end_time
    FROM (SELECT user_id, duration, unnest(range(0, 1 + greatest(0, ceil((duration - 20.0) / 15.0))::BIGINT)) AS i FROM vid))"""
FRAMES = "fr AS (SELECT user_id AS video_id, h AS timestamp, event_id::VARCHAR AS path, value FROM e WHERE event_type = 'purchase')"
COUNTED = f"""{WINDOWS}, {FRAMES}, c AS (SELECT w.video_id, w.segment_id, w.i, w.start_time, w.end_time, count(fr.path) AS n_frames, coalesce(string_agg(fr.path, ',' ORDER BY fr.timestamp, fr.path), '') AS paths
    FROM w LEFT JOIN fr ON fr.video_id = w.video_id AND fr.timestamp >= w.start_time AND fr.timestamp < w.end_time GROUP BY ALL)"""

lexical_tokens = f"WITH {DOC_TOKENS} SELECT tok AS token, count(*) AS n FROM d GROUP BY tok"
lexical_df = f"WITH {DOC_TOKENS} SELECT tok AS token, count(DISTINCT doc_id) AS df FROM d GROUP BY tok"
han_bigrams = """SELECT id, array_to_string(flatten(list_transform(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda k: CASE WHEN regexp_matches(k, '[一-鿿]') AND length(k) > 1
    THEN list_concat([k], list_transform(range(1, length(k)), lambda p: substr(k, p, 2))) ELSE [k] END)), '|') AS tokens
    FROM (VALUES (1, '检索'), (2, '字'), (3, 'AI检索 demo'), (4, 'plain words'), (5, ''), (6, '多模态检索系统')) x(id, t)"""
searchable_texts = """SELECT conv_id, turn, md5(concat_ws(chr(10), CASE WHEN role = 'user' AND trim(text, ' ' || chr(10) || chr(9)) <> '' THEN '[ASR] ' || trim(text, ' ' || chr(10) || chr(9)) END,
    CASE WHEN turn % 2 = 0 AND role <> '' THEN '[视觉] ' || role END)) AS md5 FROM conversations"""
compact_forms = r"""WITH x AS (SELECT conv_id, turn, lower(regexp_replace(text, '\s+', '', 'g')) AS a, lower(regexp_replace(text, '[^0-9A-Za-z一-鿿]', '', 'g')) AS b FROM conversations),
    y AS (SELECT *, replace(replace(b, 'the', ''), 'and', '') AS g FROM x)
    SELECT conv_id, turn, md5(a) AS spaceless, md5(b) AS alnum, md5(array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(1, length(g) - 2)), lambda p: substr(g, p, 4)))), '|')) AS grams FROM y"""
answer_characters = r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]')) AS n FROM conversations"
html_strip = r"SELECT page_id, length(t) AS n, md5(t) AS md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+', ''), '\s+$', '') AS t FROM pages)"
video_id = r"""SELECT page_id, stem || '_' || substr(sha1(url), 1, 8) AS video_id, stem AS parent FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\p{L}\p{N}]', '_', 'g') AS stem FROM pages)"""
frame_id = f"WITH {HOURS} SELECT event_id, substr(sha256(user_id::VARCHAR || chr(0) || printf('%.3f', round_even(h, 1)) || chr(0) || event_type), 1, 24) AS frame_id FROM e"
safe_filenames = r"""SELECT page_id, (CASE WHEN page_id < 100 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END) || '_' || substr(coalesce(nullif(regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'mandarin_news'), 1, 100) || CASE WHEN s IN ('.mp4', '.webm', '.ogv', '.ogg') THEN s ELSE '.webm' END AS name
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '^\s+', ''), '\s+$', '') AS t, lower(regexp_extract(url, '(\.[A-Za-z0-9]+)(#.*)?$', 1)) AS s FROM pages)"""
json_salvage = "SELECT * FROM (VALUES (1, 2::BIGINT), (2, NULL), (3, NULL), (4, 0), (5, 1)) x(id, n)"

sliding_windows = f"WITH {WINDOWS} SELECT video_id, segment_id, start_time, end_time FROM w"
segment_transcripts = f"""WITH {WINDOWS} SELECT w.segment_id, coalesce(string_agg(e.event_type, ' ' ORDER BY e.us), '') AS transcript
    FROM w LEFT JOIN e ON e.user_id = w.video_id AND e.h < w.end_time AND e.h + 0.5 > w.start_time GROUP BY w.segment_id"""
segment_keyframes = f"WITH {COUNTED} SELECT segment_id, n_frames, paths FROM c"
clean_spans = "SELECT event_type AS text, count(*) AS n FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_type <> 'error' GROUP BY event_type"

lexical_bm25_topk = f"WITH {bm25()} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM bm"
overlap_topk = f"WITH {bm25()}, {OVERLAP} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM ov"
token_overlap_rerank = f"""WITH {bm25()} SELECT b.query_id, b.segment_id, round(len(list_intersect(list_distinct(q.toks), {tok('documents.text')}))::DOUBLE / len(list_distinct(q.toks)), 6) AS rerank_score
    FROM bm b JOIN q ON q.item_id = b.query_id JOIN documents ON documents.doc_id = b.segment_id"""
model_rerank = rf"""WITH {bm25()}, pr AS (SELECT b.query_id, b.segment_id, b.rank, '<Query>: ' || q.query || chr(10) || '<Document>: Segment ID: ' || b.segment_id || chr(10) || 'Time: ' || printf('%.3f', (b.segment_id % 100)::DOUBLE) || '-' || printf('%.3f', (b.segment_id % 100) + 20.25) || ' seconds' || chr(10) || x.said AS pair
    FROM bm b JOIN q ON q.item_id = b.query_id JOIN (SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10) || chr(9)) <> '' THEN '[ASR] ' || trim(text, ' ' || chr(10) || chr(9)) ELSE '' END AS said FROM documents) x ON x.doc_id = b.segment_id),
    s AS (SELECT *, (('0x' || substr(md5(pair), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS score FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS place FROM s)
    SELECT query_id, segment_id, rank, round(score, 6) AS rerank_score, place FROM r WHERE place <= 3"""
dense_topk = f"WITH {dense('x', 'true', 'vec_id % 50 = 0', 20)} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM x"
l2_normalize_check = "SELECT vec_id AS segment_id, round(3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS before, 1.0::DOUBLE AS after FROM embeddings"
MEMBERS = "m AS (SELECT vec_id, vec_id // 4 AS segment_id FROM embeddings UNION ALL SELECT vec_id, vec_id // 4 + 1 FROM embeddings WHERE vec_id % 4 = 3)"
MEANS = f"""{MEMBERS}, flat AS (SELECT segment_id, pos, avg(x::DOUBLE) AS x FROM (SELECT m.segment_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM m JOIN embeddings USING (vec_id)) GROUP BY 1, 2),
    nrm AS (SELECT segment_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY 1)"""
segment_mean_vectors = f"WITH {MEANS} SELECT segment_id, pos AS at, round(x / n, 6) AS x FROM flat JOIN nrm USING (segment_id)"
mean_parity = f"""WITH {MEANS}, a AS (SELECT segment_id, list(x / n ORDER BY pos) AS v FROM flat JOIN nrm USING (segment_id) GROUP BY 1), b AS (SELECT vec_id // 4 AS segment_id, v AS o FROM {unit(where='vec_id % 16 = 0')})
    SELECT count(*) AS n, round(min(c), 5) AS min_cosine, round(avg(c), 5) AS mean_cosine, round(max(c), 5) AS max_cosine, round(max(g), 5) AS max_abs_difference
    FROM (SELECT list_dot_product(v, o) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(o, o)) AS c, list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - o[i]))) AS g FROM a JOIN b USING (segment_id))""".replace("vec_id % 16 = 0", "vec_id % 4 = 0 AND (vec_id // 4) * 4 = vec_id")
frame_dedupe = f"""WITH {WINDOWS}, {FRAMES} SELECT fr.path, fr.video_id, string_agg(w.segment_id, ',' ORDER BY w.i) AS segment_ids FROM fr JOIN w ON fr.video_id = w.video_id AND fr.timestamp >= w.start_time AND fr.timestamp < w.end_time GROUP BY 1, 2"""


def frame_ctes(aggregate: str, name: str = "ag", depth: int = 200, prefix: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, segment_id, score, best_frame, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
    SELECT query_id, segment_id, {aggregate}(score) AS score, arg_min(vec_id, n) AS best_frame FROM (
        SELECT f.query_id, m.segment_id, f.segment_id AS vec_id, f.score, row_number() OVER (PARTITION BY f.query_id, m.segment_id ORDER BY round(f.score, 9) DESC, f.segment_id) AS n
        FROM x f JOIN m ON m.vec_id = f.segment_id) WHERE n <= 2 GROUP BY 1, 2)) WHERE rank <= 20)"""


def frame_topk(aggregate: str) -> str:
    return f"WITH {dense('x', 'true', 'vec_id % 50 = 0', 200)}, {MEMBERS}, {frame_ctes(aggregate)} SELECT query_id, segment_id, round(score, 6) AS score, best_frame, rank FROM ag"


granularity_parity = f"""WITH {dense('x', 'true', 'vec_id % 50 = 0', 200)}, {MEMBERS}, {frame_ctes('max', 'a')}, {frame_ctes('avg', 'b')},
    la AS (SELECT query_id, list(segment_id ORDER BY rank) AS l FROM a WHERE rank <= 10 GROUP BY 1), lb AS (SELECT query_id, list(segment_id ORDER BY rank) AS r FROM b WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, l[1] = r[1] AS same_top1, l = r AS same_order, list_sort(l) = list_sort(r) AS same_set FROM la JOIN lb USING (query_id)"""

ROUTES = f"{bm25()}, {OVERLAP}, {dense('dn', 'true', 'vec_id IN (SELECT item_id FROM benchmark)', 20)}"
UNION = """h AS (SELECT query_id, 'lexical' AS route, rank AS pos, segment_id, rank FROM bm UNION ALL SELECT query_id, 'dense', rank, segment_id, rank FROM dn UNION ALL SELECT query_id, 'overlap', rank, segment_id, rank FROM ov)"""


def fused(routes: tuple[str, ...]) -> str:
    some = ", ".join(f"'{r}'" for r in routes)
    return f"""WITH {ROUTES}, {UNION}, f AS (SELECT query_id, segment_id, sum(1.0::DOUBLE / (60 + pos)) AS score, string_agg(DISTINCT route, '+' ORDER BY route) AS source FROM h WHERE route IN ({some}) GROUP BY 1, 2)
    SELECT * FROM (SELECT query_id, segment_id, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM f) WHERE rank <= 20"""


SETS = [("dense",), ("lexical",), ("overlap",), ("dense", "lexical"), ("dense", "overlap"), ("lexical", "overlap"), ("dense", "lexical", "overlap")]


def _set(routes: tuple[str, ...]) -> str:
    some, name = ", ".join(f"'{r}'" for r in routes), "+".join(routes)
    if len(routes) == 1:
        return f"SELECT '{name}' AS route_set, segment_id, rank FROM h WHERE route = '{routes[0]}'"
    return f"""SELECT '{name}' AS route_set, segment_id, rank FROM (SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank
    FROM (SELECT query_id, segment_id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM h WHERE route IN ({some}) GROUP BY 1, 2)) WHERE rank <= 20"""


route_subsets = f"WITH {ROUTES}, {UNION}, s AS ({' UNION ALL '.join(map(_set, SETS))}) SELECT route_set, count(*) AS hits, sum(rank * (segment_id + 1))::BIGINT AS checksum FROM s GROUP BY 1"

SAID_TOKENS = f"d AS (SELECT doc_id, unnest({tok(chr(39) + '[ASR] ' + chr(39) + ' || text')}) AS tok FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '')"
ASK = f"""{bm25(SAID_TOKENS)}, sc AS (SELECT b.query_id, b.segment_id, b.rank AS fused_rank, len(list_intersect(list_distinct(q.toks), {tok(chr(39) + '[ASR] ' + chr(39) + ' || documents.text')}))::DOUBLE / len(list_distinct(q.toks)) AS rr, documents.text
    FROM bm b JOIN q ON q.item_id = b.query_id JOIN documents ON documents.doc_id = b.segment_id),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, fused_rank) AS place FROM sc),
    best AS (SELECT query_id, max(rr) AS top, string_agg(segment_id::VARCHAR, ',' ORDER BY place) AS ids, arg_min(segment_id, place) AS sid, arg_min(text, place) AS txt FROM pl WHERE place <= 3 GROUP BY 1)"""
ask_batch = rf"""WITH {ASK} SELECT q.item_id AS query_id, coalesce(top, 0) < 0.9 AS abstained,
    md5(CASE WHEN coalesce(top, 0) >= 0.9 THEN regexp_replace(regexp_replace(txt, '^\s+', ''), '\s+$', '') || '（证据：' || sid::VARCHAR || '，' || printf('%.1f', (sid % 100)::DOUBLE) || '–' || printf('%.1f', round_even((sid % 100) + 20.25, 1)) || '秒）' ELSE '根据当前视频内容无法确定。' END) AS answer_md5,
    CASE WHEN coalesce(top, 0) >= 0.9 THEN ids ELSE '' END AS evidence_ids FROM q LEFT JOIN best ON best.query_id = q.item_id"""
abstentions = f"WITH {ASK} SELECT q.item_id AS query_id, 0::BIGINT AS n_evidence FROM q LEFT JOIN best ON best.query_id = q.item_id WHERE coalesce(top, 0) < 0.9 UNION ALL SELECT -1, 0"
RELEVANT = "rel AS (SELECT item_id AS query_id, doc_id AS segment_id FROM benchmark b JOIN documents x ON contains(x.text, b.text))"
relevance_pairs = f"WITH {RELEVANT} SELECT query_id, segment_id FROM rel"
METRICS = f"""{bm25()}, {RELEVANT}, n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
    g AS (SELECT query_id, min(rank) AS first, {', '.join(f'sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg{k}' for k in (1, 5, 10))} FROM bm JOIN rel USING (query_id, segment_id) GROUP BY 1),
    one AS (SELECT n.query_id, {', '.join(f'CASE WHEN first <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_at_{k}' for k in (1, 5, 10))}, coalesce(1.0::DOUBLE / first, 0) AS mrr,
    {', '.join(f'coalesce(dcg{k}, 0) / list_sum(list_transform(range(1, least({k}, n_relevant) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_{k}' for k in (1, 5, 10))} FROM n LEFT JOIN g USING (query_id))"""
MEASURES = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_1", "ndcg_at_5", "ndcg_at_10"))


def measured(runs: str, keys: tuple[str, ...], truth: str = "rel", cutoffs: tuple[int, ...] = (1, 5, 10)) -> str:
    """CTEs up to av: the measures of each run of runs(keys, query_id, segment_id, rank)."""
    own = ", ".join(keys)
    return f"""tn AS (SELECT query_id, count(*) AS n_relevant FROM {truth} GROUP BY 1), names AS (SELECT DISTINCT {own} FROM {runs}),
    mg AS (SELECT {own}, query_id, min(rank) AS first, {', '.join(f'sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg{k}' for k in cutoffs)} FROM {runs} JOIN {truth} USING (query_id, segment_id) GROUP BY ALL),
    mo AS (SELECT {own}, tn.query_id, {', '.join(f'CASE WHEN first <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_at_{k}' for k in cutoffs)}, coalesce(1.0::DOUBLE / first, 0) AS mrr,
    {', '.join(f'coalesce(dcg{k}, 0) / list_sum(list_transform(range(1, least({k}, n_relevant) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_{k}' for k in cutoffs)} FROM tn CROSS JOIN names LEFT JOIN mg USING ({own}, query_id)),
    av AS (SELECT {own}, count(*) AS questions, {', '.join(f'round(avg({m}), 6) AS {m}' for m in (*(f'recall_at_{k}' for k in cutoffs), 'mrr', *(f'ndcg_at_{k}' for k in cutoffs)))} FROM mo GROUP BY ALL)"""


def _run(routes: tuple[str, ...]) -> str:
    return _set(routes).replace(" AS route_set, segment_id, rank", " AS run, query_id, segment_id, rank", 1)


route_ablation = rf"""WITH {ROUTES}, {UNION}, {RELEVANT}, s0 AS ({' UNION ALL '.join(map(_run, SETS))}),
    pr AS (SELECT b.query_id, b.segment_id, b.rank, '<Query>: ' || q.query || chr(10) || '<Document>: Segment ID: ' || b.segment_id || chr(10) || 'Time: ' || printf('%.3f', (b.segment_id % 100)::DOUBLE) || '-' || printf('%.3f', (b.segment_id % 100) + 20.25) || ' seconds' || chr(10) || x.said AS pair
    FROM s0 b JOIN q ON q.item_id = b.query_id JOIN (SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10) || chr(9)) <> '' THEN '[ASR] ' || trim(text, ' ' || chr(10) || chr(9)) ELSE '' END AS said FROM documents) x ON x.doc_id = b.segment_id WHERE b.run = 'dense+lexical+overlap'),
    rr AS (SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round((('0x' || substr(md5(pair), 1, 8))::BIGINT + 0.5) / 4294967296.0, 9) DESC, rank) AS rank FROM pr),
    runs AS (SELECT run, query_id, segment_id, rank FROM s0 UNION ALL SELECT 'dense+lexical+overlap+reranker', query_id, segment_id, rank FROM rr), {measured('runs', ('run',))} SELECT * FROM av"""


def _depth(aggregate: str, depth: int) -> str:
    return f"""SELECT '{'max' if aggregate == 'max' else 'top2_mean'}' AS aggregation, {depth}::BIGINT AS depth, query_id, segment_id, rank FROM (SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
    SELECT query_id, segment_id, {aggregate}(score) AS score FROM (SELECT f.query_id, m.segment_id, f.score, row_number() OVER (PARTITION BY f.query_id, m.segment_id ORDER BY round(f.score, 9) DESC, f.segment_id) AS n
    FROM x f JOIN m ON m.vec_id = f.segment_id WHERE f.rank <= {depth}) WHERE n <= 2 GROUP BY 1, 2)) WHERE rank <= 20"""


granularity_grid = f"""WITH {dense('x', 'true', 'vec_id % 50 = 0', 200)}, {MEMBERS}, runs AS ({' UNION ALL '.join(_depth(a, k) for a in ('max', 'avg') for k in (20, 50, 100, 200))}),
    rel AS (SELECT vec_id AS query_id, vec_id // 4 AS segment_id FROM embeddings WHERE vec_id % 50 = 0), {measured('runs', ('aggregation', 'depth'), cutoffs=(1, 5))},
    c AS (SELECT aggregation, depth, query_id, count(*) AS n FROM runs GROUP BY ALL) SELECT av.*, fewest, mean_returned, most FROM av JOIN (SELECT aggregation, depth, min(n) AS fewest, round(avg(n), 6) AS mean_returned, max(n) AS most FROM c GROUP BY ALL) USING (aggregation, depth)"""
retrieval_metrics = f"WITH {METRICS} SELECT count(*) AS questions, {MEASURES} FROM one"
metrics_by_type = f"WITH {METRICS}, t AS (SELECT *, ['audio', 'visual', 'ocr', 'multimodal'][query_id % 4 + 1] AS question_type FROM one) SELECT coalesce(question_type, 'all') AS question_type, count(*) AS questions, {MEASURES} FROM t GROUP BY ROLLUP (question_type)"
answer_em_f1 = r"""WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]') AS r, lead(role) OVER w AS nr, lead(regexp_extract_all(lower(text), '[\p{L}\p{N}_]')) OVER w AS np FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, r, CASE WHEN nr = 'assistant' THEN np ELSE [] END AS p FROM t WHERE role = 'user'),
    k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(r), lambda c: least(len(list_filter(r, lambda x: x = c)), len(list_filter(p, lambda y: y = c))))), 0) AS n FROM p)
    SELECT conv_id, turn, CASE WHEN r = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, round(CASE WHEN len(r) + len(p) = 0 THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / (len(r) + len(p)) END, 6) AS token_f1 FROM k"""
rank_delta = f"""WITH {ROUTES}, {UNION}, {RELEVANT}, f AS (SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (SELECT query_id, segment_id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM h GROUP BY 1, 2)),
    a AS (SELECT query_id, min(rank) AS r FROM f JOIN rel USING (query_id, segment_id) WHERE rank <= 20 GROUP BY 1), b AS (SELECT query_id, min(rank) AS r FROM bm JOIN rel USING (query_id, segment_id) GROUP BY 1),
    z AS (SELECT q0.query_id, coalesce(b.r, 999) AS before, coalesce(a.r, 999) AS after FROM (SELECT DISTINCT query_id FROM rel) q0 LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id))
    SELECT query_id, before, after, CASE WHEN after < before THEN 'improved' WHEN after > before THEN 'regressed' ELSE 'unchanged' END AS change FROM z"""
percentiles_linear = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1"
percentiles_nearest = "SELECT o_orderpriority, l[1 + round_even((len(l) - 1) * 0.95, 0)::BIGINT] AS p95, l[1 + round_even((len(l) - 1) * 0.5, 0)::BIGINT] AS p50 FROM (SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice) AS l FROM orders GROUP BY 1)"
latency_report = """SELECT route, len(l) AS n, round(list_avg(l), 4) AS mean, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99, round(mx, 4) AS max, round(l[1 + round_even((len(l) - 1) * 0.95, 0)::BIGINT], 4) AS p95_nearest
    FROM (SELECT event_type AS route, list(value ORDER BY value) AS l, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS mx FROM events WHERE value IS NOT NULL GROUP BY 1)"""

keyframe_coverage = f"WITH {COUNTED} SELECT video_id, count(*) AS segments, count(*) FILTER (n_frames = 0) AS empty, sum(n_frames)::BIGINT AS memberships, round(avg(n_frames), 6) AS mean, min(n_frames) AS least, max(n_frames) AS most, round(median(n_frames), 6) AS median, round(quantile_cont(n_frames, 0.9), 6) AS p90 FROM c GROUP BY 1"
frame_gaps = f"""WITH {WINDOWS}, {FRAMES}, m AS (SELECT video_id, timestamp FROM fr UNION ALL SELECT user_id, 0.0::DOUBLE FROM vid), n AS (SELECT video_id, timestamp, lead(timestamp) OVER (PARTITION BY video_id ORDER BY timestamp) AS nx FROM m)
    SELECT n.video_id, round(n.timestamp, 6) AS gap_start, round(coalesce(nx, duration) - n.timestamp, 6) AS gap FROM n JOIN vid ON vid.user_id = n.video_id"""
longest_zero_run = f"""WITH {COUNTED}, s AS (SELECT *, sum(CASE WHEN n_frames > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_time, end_time, segment_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
    r AS (SELECT video_id, island, count(*) AS run, min(start_time) AS start, arg_max(end_time, start_time) AS "end", string_agg(segment_id, ',' ORDER BY start_time, end_time, segment_id) AS segment_ids FROM s WHERE n_frames = 0 GROUP BY 1, 2)
    SELECT video_id, run, round(start, 3) AS start, round("end", 3) AS "end", round("end" - start, 3) AS span, segment_ids FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY run DESC, start) AS n FROM r) WHERE n = 1"""
boundary_reuse = f"""WITH {COUNTED} SELECT c.video_id, c.segment_id, round(min(least(abs(fr.timestamp - c.start_time), abs(fr.timestamp - c.end_time))), 6) AS distance FROM c JOIN fr ON fr.video_id = c.video_id WHERE c.n_frames = 0 GROUP BY 1, 2
    HAVING min(least(abs(fr.timestamp - c.start_time), abs(fr.timestamp - c.end_time))) <= 2"""
SIGNS = "sg AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 THEN 1 ELSE 0 END) AS b FROM embeddings)"
near_dup_frames = f"""WITH {SIGNS}, n AS (SELECT vec_id // 25 AS video_id, vec_id, b, lag(b) OVER w AS pb, lag(vec_id) OVER w AS pv FROM sg WINDOW w AS (PARTITION BY vec_id // 25 ORDER BY vec_id))
    SELECT video_id, pv::DOUBLE AS first, vec_id::DOUBLE AS second, dist AS distance FROM (SELECT *, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] <> pb[i] THEN 1 ELSE 0 END))::BIGINT AS dist FROM n WHERE pb IS NOT NULL) WHERE dist <= 28"""
exact_duplicates = "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1"
reuse_counts = "SELECT sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS reused, count(*) AS contents, max(n) AS most FROM (SELECT count(*) AS n FROM documents GROUP BY text)"
histogram = f"WITH {COUNTED} SELECT n_frames, count(*) AS segments FROM c GROUP BY 1"
supplement_choice = f"""WITH {SIGNS}, k AS (SELECT b AS kb FROM sg WHERE vec_id % 100 = 0), t AS (SELECT vec_id, min(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] <> kb[i] THEN 1 ELSE 0 END)))::BIGINT AS nearest FROM sg CROSS JOIN k WHERE vec_id % 100 <> 0 GROUP BY 1),
    r AS (SELECT vec_id // 100 AS video_id, (vec_id % 100) // 5 AS ordinal, vec_id % 5 AS attempt, vec_id::DOUBLE AS timestamp, nearest FROM t)
    SELECT video_id, ordinal, attempt, timestamp, nearest, nearest <= 20 AS near_duplicate FROM (SELECT *, row_number() OVER (PARTITION BY video_id, ordinal ORDER BY nearest > 20 DESC, CASE WHEN nearest > 20 THEN attempt ELSE -1 END, nearest DESC, attempt) AS n FROM r) WHERE n = 1"""


def planned(target: int) -> str:
    """CTEs up to p(video_id, ordinal, timestamp, ids, aimed): a step of the recursion is a timestamp of each video, taken from the
    first segment that lacks frames and what it shares with those after it."""
    lacks = f"list_filter(segs, lambda s: s.n < {target})"
    common = "{{'a': greatest(x.a, y.a), 'b': least(x.b, y.b)}}".replace("{{", "{").replace("}}", "}")
    return f"""WITH RECURSIVE {COUNTED}, v AS (SELECT video_id, list({{'a': start_time, 'b': end_time, 'id': segment_id, 'n': n_frames}} ORDER BY start_time, end_time, segment_id) AS segs FROM c GROUP BY video_id),
    p(video_id, ordinal, timestamp, ids, aimed, segs) AS (SELECT video_id, -1, 0.0::DOUBLE, []::VARCHAR[], []::VARCHAR[], segs FROM v UNION ALL (
      WITH a AS (SELECT video_id, ordinal, segs, list_transform({lacks}, lambda s: {{'a': s.a, 'b': s.b}}) AS open FROM p WHERE len({lacks}) > 0),
      b AS (SELECT *, list_reduce(open, lambda x, y: CASE WHEN greatest(x.a, y.a) < least(x.b, y.b) THEN {common} ELSE x END) AS r FROM a),
      t AS (SELECT *, printf('%.3f', (r.a + r.b) / 2.0)::DOUBLE AS tm FROM b),
      h AS (SELECT *, list_filter(segs, lambda s: s.a <= tm AND tm < s.b) AS hit FROM t),
      g AS (SELECT *, list_transform(list_filter(hit, lambda s: s.n < {target}), lambda s: s.id) AS lacking, list_transform({lacks}, lambda s: s.id)[1:1] AS earliest FROM h),
      f AS (SELECT *, CASE WHEN len(lacking) > 0 THEN lacking ELSE earliest END AS goal FROM g)
      SELECT video_id, ordinal + 1, tm, list_transform(hit, lambda s: s.id), goal, list_transform(segs, lambda s: {{'a': s.a, 'b': s.b, 'id': s.id, 'n': s.n + CASE WHEN list_contains(goal, s.id) THEN 1 ELSE 0 END}}) FROM f))"""


supplement_plan = f"{planned(1)} SELECT video_id::VARCHAR AS video_id, ordinal, timestamp, array_to_string(ids, ',') AS segment_ids, array_to_string(aimed, ',') AS targeted FROM p WHERE ordinal >= 0"
supplement_totals = f"""{planned(2)} SELECT count(*) AS new_frames, sum(len(ids))::BIGINT AS new_memberships, sum(len(aimed))::BIGINT AS coverage_gains, (sum(len(ids)) - count(*))::BIGINT AS reused_memberships,
    count(*) * 120000 AS image_bytes, count(*) * 2048 AS vector_bytes FROM p WHERE ordinal >= 0"""

DECISIONS = """dec AS (SELECT user_id AS question_id, event_id, row_number() OVER w AS sequence, lag(event_id) OVER w AS previous_event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'accept' WHEN event_type = 'error' THEN 'reject' ELSE 'reopen' END AS action FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    lt AS (SELECT question_id, arg_max(event_id, sequence) AS event_id, arg_max(action, sequence) AS action, max(sequence) AS sequence FROM dec GROUP BY 1)"""
review_requests = f"""WITH {DECISIONS}, a AS (SELECT question_id, question_id % 8 AS kind, event_id FROM lt UNION ALL SELECT question_id + 1000000000, question_id % 8, event_id FROM lt WHERE question_id % 3 = 0),
    r AS (SELECT a.*, CASE WHEN lt.question_id IS NULL THEN '400 unknown question or action' ELSE ['', '400 accept needs playback', '400 reject needs a reason', '', '409 stale base event', '400 reopen needs a reason', '', '400 question_id and video_id must not change'][kind + 1] END AS refusal FROM a LEFT JOIN lt USING (question_id))
    SELECT question_id, refusal, CASE WHEN refusal = '' THEN 100 + row_number() OVER (PARTITION BY refusal ORDER BY question_id) END AS sequence, CASE WHEN refusal = '' THEN event_id END AS previous_event_id FROM r"""
latest_decision = f"WITH {DECISIONS} SELECT question_id, event_id, action, sequence FROM lt"
review_progress = f"WITH {DECISIONS} SELECT count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action IS NULL OR action = 'reopen') AS pending, count(*) AS total FROM customer LEFT JOIN lt ON question_id = c_custkey"
export_counts = f"WITH {DECISIONS} SELECT count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action IS NULL) AS pending, count(*) FILTER (action = 'accept') >= 10 AS formal_metric_eligible FROM customer LEFT JOIN lt ON question_id = c_custkey"
exported = f"WITH {DECISIONS} SELECT c_custkey AS question_id, c_name AS question FROM customer WHERE c_custkey IN (SELECT question_id FROM lt WHERE action = 'accept')"
next_question = f"""WITH {DECISIONS}, o AS (SELECT c_custkey AS id, c_mktsegment AS t, c_acctbal > 0 AS a FROM customer WHERE c_custkey NOT IN (SELECT question_id FROM lt WHERE action IN ('accept', 'reject')))
    SELECT * FROM (SELECT id AS question_id FROM o WHERE t = 'BUILDING' ORDER BY id <= 100, id LIMIT 1) UNION ALL SELECT * FROM (SELECT id FROM o ORDER BY id <= 1000000000, id LIMIT 1) UNION ALL SELECT * FROM (SELECT id FROM o WHERE NOT a ORDER BY id <= 20, id LIMIT 1)"""
review_chain_violations = f"""WITH {DECISIONS}, l AS (SELECT event_id AS line_no, event_id, event_id + CASE WHEN event_id % 501 = 0 THEN 1 ELSE 0 END AS sequence, CASE WHEN event_id % 97 = 0 THEN -1 ELSE previous_event_id END AS prev, question_id, CASE WHEN event_id % 53 = 0 THEN 'other' ELSE action END AS action FROM dec),
    k AS (SELECT a.*, b.sequence AS before, lag(a.event_id) OVER (PARTITION BY a.question_id ORDER BY a.line_no) AS expected FROM l a LEFT JOIN l b ON b.line_no + 1 = a.line_no),
    v AS (SELECT line_no, 2 AS rule, 'non-monotonic sequence' AS message FROM k WHERE sequence <> coalesce(before, 0) + 1 UNION ALL SELECT line_no, 3, 'unknown question' FROM k WHERE question_id NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT line_no, 4, 'broken question revision chain' FROM k WHERE prev IS DISTINCT FROM expected UNION ALL SELECT line_no, 5, 'invalid action' FROM k WHERE action = 'other')
    SELECT rule, message, count(*) AS n, min(line_no) AS first FROM v GROUP BY 1, 2"""

# One row for each rule that question i breaks: condition, rule, message.
BROKEN = [
    ("m = 0", 1, "missing fields question"),
    ("m = 1 OR m = 2 AND i > (SELECT min(i) FROM qs WHERE m = 2)", 2, "duplicate or empty question_id"),
    ("m = 3", 3, "unsupported question_type"),
    ("m = 4", 4, "unsupported verification_status"),
    ("m = 5", 5, "verified item requires annotation_source"),
    ("m IN (5, 6)", 6, "verified item annotation_source must be human_review"),
    ("m = 7", 7, "verified item requires reviewer_id"),
    ("m = 8", 8, "verified item requires timezone-aware reviewed_at"),
    ("m = 9", 9, "verified item requires append-only review_event_id"),
    ("m = 10", 10, "invalid split"),
    ("m = 13 AND before", 11, "video leaks across splits"),
    ("m = 15 AND before", 12, "paraphrase group leaks across splits"),
    ("m = 17", 15, "answerable item requires answer"),
    ("m = 18", 16, "answer_aliases must be a list of non-empty strings"),
    ("m = 19", 16, "answer_aliases must not contain duplicates"),
    ("m = 17", 16, "answer_aliases must include the canonical answer"),
    ("m = 20", 17, "unanswerable item must not contain relevant segments"),
    ("m = 21", 18, "answerable item requires relevant segments"),
    ("m = 22", 19, "unknown segment xN"),
    ("m = 23 AND NOT before", 19, "unknown segment N"),
    ("m = 23 AND before", 20, "segment of another video N"),
    ("m = 24", 21, "invalid evidence interval"),
    ("m = 25", 22, "evidence interval exceeds actual video duration"),
    ("m = 26", 23, "no overlap with the evidence interval: N"),
    ("m = 27", 24, "unanswerable evidence interval must be null"),
    ("m = 28", 25, "verified item requires modality_evidence object"),
    ("m = 29", 26, "unanswerable item must not claim supporting modality evidence"),
    ("m = 29", 27, "verified unanswerable item requires a valid unanswerable_reason"),
    ("m = 29", 28, "verified unanswerable item requires checked_time_ranges"),
    ("m = 28", 29, "verified audio item requires ASR quote and segment_ids"),
    ("m = 16", 14, "answerable must be boolean"),
    ("m = 16", 17, "unanswerable item must not contain relevant segments"),
    ("m = 16", 24, "unanswerable evidence interval must be null"),
    ("m IN (30, 35)", 30, "verified visual item requires frame timestamps"),
    ("m IN (31, 37)", 31, "verified OCR item requires OCR text and frame timestamps"),
    ("m IN (32, 39)", 32, "verified multimodal item requires at least two valid modality sources"),
]
QS = "WITH qs AS (SELECT doc_id AS i, doc_id % 40 AS m, doc_id - 1 IN (SELECT doc_id FROM documents) AS before FROM documents)"
question_violations = QS + " UNION ALL ".join(f" SELECT i + 1 AS line, {rule}::BIGINT AS rule, '{message}' AS message FROM qs WHERE {where}" for where, rule, message in BROKEN)
frozen_split_violations = QS + " SELECT i + 1 AS line, 'verified item requires frozen split' AS message FROM qs WHERE m IN (5, 6, 7, 8, 9, 25) OR m >= 28"
question_summary = QS + """, v AS (SELECT *, (m IN (5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 25) OR m >= 28) AS verified FROM qs WHERE m <> 0),
    p AS (SELECT 'question_type' AS kind, CASE WHEN m = 3 THEN 'smell' WHEN m IN (30, 34, 35) THEN 'visual' WHEN m IN (31, 36, 37) THEN 'ocr' WHEN m IN (32, 38, 39) THEN 'multimodal' ELSE 'audio' END AS value FROM v
        UNION ALL SELECT 'verification_status', CASE WHEN m = 4 THEN 'unsure' WHEN verified THEN 'verified' ELSE 'generated_candidate' END FROM v
        UNION ALL SELECT 'split', CASE WHEN m = 10 THEN 'train' WHEN m IN (12, 14) THEN 'development' ELSE 'test' END FROM v WHERE m IN (10, 12, 13, 14, 15)
        UNION ALL SELECT 'answerable', CASE WHEN m IN (20, 27, 29) THEN 'false' ELSE 'true' END FROM v WHERE m <> 16),
    c AS (SELECT kind, value, count(*) AS n FROM p GROUP BY ALL)
    SELECT * FROM c UNION ALL SELECT 'warning', 'question types are severely imbalanced (>70% in one type)', 1 FROM c WHERE kind = 'question_type' HAVING max(n) > 0.7 * sum(n)
    UNION ALL SELECT 'warning', 'dataset contains no human-verified questions', 1 WHERE NOT EXISTS (SELECT * FROM c WHERE value = 'verified')"""
type_imbalance = f"SELECT * FROM ({question_summary}) WHERE kind = 'warning'"
left_anti = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def breaking(*rules: int) -> str:
    return f"SELECT * FROM ({question_violations}) WHERE rule IN ({', '.join(map(str, rules))})"


category_counts = "SELECT coalesce(lang, 'all') AS lang, coalesce(quality::VARCHAR, 'all') AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)"
range_coverage = """SELECT * FROM (VALUES (1, ''), (2, 'checked_time_ranges overlap'), (3, 'verified unanswerable review must cover the full video'), (4, ''), (5, 'verified unanswerable review must cover the full video'),
    (6, 'checked_time_ranges contain an invalid range'), (7, 'verified unanswerable review must cover the full video'), (8, '')) x(id, problems)"""

round_robin = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents"
prompt_batches = """WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents)
    SELECT lang AS "group", (place - 1) // 6 AS batch_no, substr(sha256(lang || '|' || string_agg(doc_id::VARCHAR, ',' ORDER BY place)), 1, 20) AS batch_id, count(*) AS n FROM p GROUP BY lang, (place - 1) // 6"""
budgeted_selection = "SELECT p_partkey, round(total, 3) AS total FROM (SELECT p_partkey, sum(p_retailprice) OVER (ORDER BY p_retailprice, p_partkey) AS total, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE total <= 50000 AND n <= 40"
first_occurrences = "SELECT min(doc_id % 2) AS part, arg_min(doc_id, (doc_id % 2) * 1000000000 + doc_id) AS doc_id FROM documents GROUP BY text"
video_components = """WITH RECURSIVE v AS (SELECT DISTINCT 'v' || (doc_id % 200) AS video_id, CASE WHEN doc_id % 40 = 0 THEN doc_id % 7 END AS p FROM documents), e AS (SELECT DISTINCT a.video_id AS a, b.video_id AS b FROM v a JOIN v b USING (p)),
    r(video_id, reach) AS (SELECT DISTINCT video_id, video_id FROM v UNION SELECT r.video_id, e.b FROM r JOIN e ON e.a = r.reach) SELECT video_id, min(reach) AS component FROM r GROUP BY 1"""
split_feasibility = """WITH q AS (SELECT 'v' || (doc_id % 200) AS video_id, ['audio', 'visual', 'ocr', 'multimodal', 'unknown_route'][doc_id % 5 + 1] AS t, CASE WHEN doc_id % 200 % 20 < 14 THEN 'development' WHEN doc_id % 200 % 20 < 17 THEN 'validation' ELSE 'test' END AS s FROM documents),
    k AS (SELECT unnest(['audio', 'visual', 'ocr', 'multimodal', 'unknown_route', 'absent']) AS question_type)
    SELECT question_type, count(q.t) AS questions, count(DISTINCT video_id) AS videos, count(DISTINCT video_id) >= 3 AS at_least_three, count(DISTINCT video_id) >= 6 AS at_least_six,
    concat_ws(',', CASE WHEN count(*) FILTER (s = 'development') = 0 THEN 'development' END, CASE WHEN count(*) FILTER (s = 'validation') = 0 THEN 'validation' END, CASE WHEN count(*) FILTER (s = 'test') = 0 THEN 'test' END) AS missing_splits
    FROM k LEFT JOIN q ON q.t = question_type GROUP BY 1"""

prompt_texts = """SELECT conv_id AS batch_id, count(*) AS n, md5(string_agg(substr(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role ELSE 'ASR: ' || text || chr(10) || '视觉描述: ' || role END, 1, 1800), '|' ORDER BY turn)) AS md5
    FROM conversations GROUP BY 1"""
seed_fields = "SELECT doc_id, source AS video_id, true AS answerable, 'generated_candidate' AS verification_status FROM documents"
review_contexts = """WITH s AS (SELECT doc_id, source, '[' || doc_id || '] ' || printf('%.1f-%.1fs', doc_id::DOUBLE, round_even(doc_id + 20.25, 1)) || chr(10) || 'ASR: ' || text || chr(10) || '视觉描述: ' || lang AS t, doc_id || '.jpg' AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    x AS (SELECT doc_id AS question_id, doc_id AS seg FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT q.doc_id, s.doc_id FROM documents q JOIN s ON s.source = q.source AND s.n <= 2 WHERE q.doc_id % 2 <> 0)
    SELECT question_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY seg)) AS evidence_md5, string_agg(f, ',' ORDER BY seg) AS frames FROM x JOIN s ON s.doc_id = x.seg GROUP BY 1"""
