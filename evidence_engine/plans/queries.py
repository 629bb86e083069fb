"""Every operator on the driver's tables: a query, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.functions import text, vectors
from evidence_engine.operators import adapters, ask, audit, evaluate, prepare, retrieval, review, segment, validate
from evidence_engine.plans import sql as Q
from evidence_engine.sources import index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("segment_id"), F.col("source").alias("video_id"), "text", "n_chars", "lang")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, whole."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "text")


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"), "event_type", "value", hours.alias("us"), (hours / F.lit(3600000000.0)).alias("h"))


def videos(events: DataFrame) -> DataFrame:
    return events.groupBy("video_id").agg(F.max("h").alias("duration")).where("duration > 0")


def windows(events: DataFrame) -> DataFrame:
    return segment.build_windows(videos(events), 20.0, 5.0)


def purchases(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select("video_id", F.col("h").alias("timestamp"), F.col("event_id").cast("string").alias("path"), F.lit("").alias("caption"), F.col("value").alias("score"))


def counted(events: DataFrame) -> DataFrame:
    """Windows with the number of their frames."""
    return segment.with_keyframes(windows(events), purchases(events).drop("score")).withColumn("n_frames", F.coalesce(F.size("keyframes"), F.lit(0)))


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries of searches: ids divisible by 50, against all rows."""
    return vector_rows(spark, d).where("segment_id % 50 = 0").withColumnRenamed("segment_id", "query_id")


def membership(rows: DataFrame) -> DataFrame:
    own = F.expr("segment_id div 4")
    both = F.when(F.col("segment_id") % 4 == 3, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select(F.col("segment_id").alias("frame_id"), F.explode(both).alias("segment_id"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# Text.


@query(Q.lexical_tokens)
def lexical_tokens(spark, d):
    return documents(spark, d).select(F.explode(text.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(Q.lexical_df)
def lexical_df(spark, d):
    return retrieval.document_frequency(retrieval.postings(documents(spark, d)))


@query(Q.han_bigrams)
def han_bigrams(spark, d):
    rows = spark.createDataFrame([(1, "检索"), (2, "字"), (3, "AI检索 demo"), (4, "plain words"), (5, ""), (6, "多模态检索系统")], "id int, t string")
    return rows.select("id", F.array_join(text.tokenize(F.col("t")), "|").alias("tokens"))


@query(Q.searchable_texts)
def searchable_texts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("  ").alias("t"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("c"))
    return rows.select("conv_id", "turn", F.md5(text.searchable_text(F.col("t"), F.col("c")).cast("binary")).alias("md5"))


@query(Q.compact_forms)
def compact_forms(spark, d):
    t = F.col("text")
    grams = F.array_join(F.sort_array(text.char_grams(t, ("the", "and"))), "|")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.without_space(t).cast("binary")).alias("spaceless"), F.md5(text.alnum_or_han(t).cast("binary")).alias("alnum"), F.md5(grams.cast("binary")).alias("grams"))
    return rows


@query(Q.answer_characters)
def answer_characters(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(text.answer_tokens(F.col("text"))).cast("long").alias("n"))


@query(Q.html_strip)
def html_strip(spark, d):
    t = text.strip_markup(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.char_length(t).cast("long").alias("n"), F.md5(t.cast("binary")).alias("md5"))


@query(Q.video_id)
def video_id(spark, d):
    p = table(spark, d, "pages")
    stem = F.regexp_extract("url", r"([^/]*)$", 1)
    return p.select("page_id", text.video_identifier(stem, F.col("url")).alias("video_id"), text.video_of_segment(text.video_identifier(stem, F.col("url"))).alias("parent"))


@query(Q.frame_id)
def frame_id(spark, d):
    return event_hours(spark, d).select("event_id", text.frame_identifier(F.col("video_id").cast("string"), F.bround("h", 1), F.col("event_type")).alias("frame_id"))


@query(Q.safe_filenames)
def safe_filenames(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", text.safe_filename(F.col("page_id"), text.strip_markup(F.regexp_extract("html", "<title>(.*?)</title>", 1)), F.lower(F.regexp_extract("url", r"(\.[A-Za-z0-9]+)(#.*)?$", 1))).alias("name"))


@query(Q.json_salvage)
def json_salvage(spark, d):
    rows = spark.createDataFrame([(1, 'x ```json\n[1, {"a": 2}]\n``` y'), (2, "no list"), (3, "[broken"), (4, "pre [] post"), (5, "a [1] b [2")], "id int, t string")
    return rows.select("id", F.json_array_length(text.json_array_in(F.col("t"))).cast("long").alias("n"))


# Segments.


@query(Q.sliding_windows)
def sliding_windows(spark, d):
    return windows(event_hours(spark, d)).drop("ordinal")


@query(Q.segment_transcripts)
def segment_transcripts(spark, d):
    e = event_hours(spark, d)
    spans = e.select("video_id", F.col("us").alias("ord"), F.col("h").alias("start"), (F.col("h") + 0.5).alias("end"), F.col("event_type").alias("text"))
    return segment.with_transcripts(windows(e), spans).select("segment_id", "transcript")


@query(Q.segment_keyframes)
def segment_keyframes(spark, d):
    return counted(event_hours(spark, d)).select("segment_id", F.col("n_frames").cast("long").alias("n_frames"), F.coalesce(F.array_join(F.transform("keyframes", lambda k: k["path"]), ","), F.lit("")).alias("paths"))


@query(Q.clean_spans)
def clean_spans(spark, d):
    e = event_hours(spark, d)
    end = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.col("h")).otherwise(F.col("h") + 0.5)
    chunks = e.select("event_id", F.col("h").alias("start"), end.alias("end"), F.when(F.col("event_type") == "error", F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("text"))
    return segment.clean_timed_text(chunks).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_keyframes(spark, d):
    e = event_hours(spark, d)
    return segment.greedy_keyframes(purchases(e).select("video_id", "timestamp", "score"), videos(e).withColumn("duration", F.col("duration") / 10), gap=2.0)


@query()
def scene_changes(spark, d):
    rows = vector_rows(spark, d)
    signal = rows.select(F.expr("segment_id div 50").alias("video_id"), F.col("segment_id").cast("double").alias("timestamp"), F.transform("vector", lambda x: F.abs(x).cast("double")).alias("histogram"), F.abs(F.col("vector")[0]).cast("double").alias("sharpness"))
    return segment.scene_candidates(signal).select("video_id", "timestamp", "change", "score")


# Retrieval.


def bm25(spark, d, k=20):
    return retrieval.lexical_search(documents(spark, d), questions(spark, d), k)


def bm25_hits(spark, d):
    """bm25(), kept: few rows, which what follows joins with large tables or uses more than once."""
    return index.kept(bm25(spark, d), "bm25")


@query(Q.lexical_bm25_topk)
def lexical_bm25_topk(spark, d):
    return rounded(bm25(spark, d))


@query(Q.overlap_topk)
def overlap_topk(spark, d):
    return rounded(retrieval.overlap_search(documents(spark, d), questions(spark, d)))


@query(Q.token_overlap_rerank)
def token_overlap_rerank(spark, d):
    hits = bm25_hits(spark, d).select("query_id", "segment_id").join(documents(spark, d).select("segment_id", "text"), "segment_id").join(questions(spark, d).select("query_id", "query"), "query_id")
    return hits.select("query_id", "segment_id", F.round(ask.overlap_reranker(F.col("query"), F.col("text")), 6).alias("rerank_score"))


@query(Q.model_rerank)
def model_rerank(spark, d):
    """The model's three best of each question's twenty, with a model that hashes the pair."""
    best = adapters.rerank(bm25_hits(spark, d).select("query_id", "segment_id", "rank"), document_segments(spark, d), questions(spark, d), adapters.hashing_reranker(), 3)
    return rounded(best.select("query_id", "segment_id", "rank", "rerank_score", "place"))


@query(Q.dense_topk)
def dense_topk(spark, d):
    return rounded(retrieval.dense_search(vector_rows(spark, d), vector_queries(spark, d), 20))


@query(Q.dense_topk)
def index_roundtrip(spark, d):
    """The dense search over an index that was written, checked and read again, for the rows it says it has."""
    rows = vector_rows(spark, d)
    made = index.build_index(rows, lambda segments: segments.select("segment_id", "vector"), index.scratch(spark, "index"), "given")
    return rounded(retrieval.dense_search(made.select("segment_id", "vector"), vector_queries(spark, d), 20))


@query(Q.l2_normalize_check)
def l2_normalize_check(spark, d):
    v = F.col("vector")
    scaled = vector_rows(spark, d).withColumn("vector", F.transform(v, lambda x: x * 3))
    return scaled.select("segment_id", F.round(vectors.norm(v), 5).alias("before"), F.round(vectors.norm(vectors.normalize(v)), 6).alias("after"))


@query(Q.segment_mean_vectors)
def segment_mean_vectors(spark, d):
    rows = vector_rows(spark, d)
    means = retrieval.segment_means(rows.withColumnRenamed("segment_id", "frame_id"), membership(rows))
    return means.select("segment_id", F.posexplode("vector").alias("at", "x")).select("segment_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


@query(Q.mean_parity)
def mean_parity(spark, d):
    rows = vector_rows(spark, d)
    frames = rows.withColumnRenamed("segment_id", "frame_id")
    return rounded(retrieval.cosine_parity(retrieval.segment_means(frames, membership(rows)), rows.where("segment_id % 4 = 0").select(F.expr("segment_id div 4").alias("segment_id"), vectors.normalize(F.col("vector")).alias("vector"))), 5)


@query(Q.frame_dedupe)
def frame_dedupe(spark, d):
    e = event_hours(spark, d)
    inside = segment.point_join(windows(e), purchases(e), "timestamp")
    frames = retrieval.physical_frames(inside.select("segment_id", "video_id", F.col("ordinal").alias("ord"), "timestamp", "path"))
    return frames.select("path", "video_id", F.array_join("segment_ids", ",").alias("segment_ids"))


def frame_topk(spark, d, aggregation, depth=200):
    rows = vector_rows(spark, d)
    return rounded(retrieval.frame_search(rows.withColumnRenamed("segment_id", "frame_id"), membership(rows), vector_queries(spark, d), 20, aggregation, depth))


@query(Q.frame_topk("max"))
def frame_max_topk(spark, d):
    return frame_topk(spark, d, "max")


@query(Q.frame_topk("avg"))
def frame_top2_topk(spark, d):
    return frame_topk(spark, d, "top2_mean")


@query(Q.granularity_parity)
def granularity_parity(spark, d):
    a, b = frame_topk(spark, d, "max"), frame_topk(spark, d, "top2_mean")
    return evaluate.order_parity(a, b, 10)


def routes(spark, d, names=("lexical", "dense", "overlap")) -> DataFrame:
    """The hits of each route, kept. Both searches by tokens are one."""
    q, out = questions(spark, d), None
    if by_tokens := tuple(name for name in ("lexical", "overlap") if name in names):
        out = retrieval.term_search(documents(spark, d), q, 20, by_tokens).select("query_id", "route", "segment_id", "rank")
    if "dense" in names:
        rows = vector_rows(spark, d)
        asked = rows.withColumnRenamed("segment_id", "query_id").join(q.select("query_id"), "query_id", "left_semi")
        dense = retrieval.dense_search(rows, asked, 20).select("query_id", F.lit("dense").alias("route"), "segment_id", "rank")
        out = dense if out is None else out.unionByName(dense)
    hits = index.kept(out, "routes")
    return hits.select("query_id", "route", F.col("rank").alias("pos"), "segment_id", F.when(F.col("segment_id") % 3 == 0, 0).otherwise(F.col("rank")).alias("rank"))


@query(Q.fused(("lexical", "dense")))
def rrf_two_routes(spark, d):
    return rounded(retrieval.fuse(routes(spark, d, ("lexical", "dense")), 60, 20))


@query(Q.fused(("lexical", "dense", "overlap")))
def rrf_three_routes(spark, d):
    return rounded(retrieval.fuse(routes(spark, d), 60, 20))


@query(Q.route_subsets)
def route_subsets(spark, d):
    hits = routes(spark, d).withColumn("rank", F.col("pos")).withColumn("score", 1.0 / F.col("pos"))
    return retrieval.route_sets(hits, ("dense", "lexical", "overlap"), 60, 20).groupBy("route_set").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("rank") * (F.col("segment_id") + 1)).alias("checksum"))


# Questions and answers.


def document_segments(spark, d) -> DataFrame:
    start = (F.col("segment_id") % 100).cast("double")
    return documents(spark, d).select("segment_id", "video_id", F.concat(F.col("video_id"), F.lit(".mp4")).alias("source_path"), start.alias("start_time"), (start + 20.25).alias("end_time"), F.col("text").alias("transcript"), F.lit("").alias("visual_caption"))


def pipeline(spark, d, minimum) -> ask.Pipeline:
    return ask.Pipeline([ask.Lexical()], minimum_rerank_score=minimum).build(document_segments(spark, d))


@query(Q.ask_batch)
def ask_batch(spark, d):
    out = pipeline(spark, d, 0.9).ask_batch(questions(spark, d).select("query_id", "query"))
    return out.select("query_id", "abstained", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.array_join(F.transform("evidence", lambda e: e["segment_id"]), ",").alias("evidence_ids"))


@query(Q.abstentions)
def abstentions(spark, d):
    asked = questions(spark, d).select("query_id", "query").unionByName(spark.createDataFrame([(-1, "zzzqqq xxxyyy")], "query_id long, query string"))
    return pipeline(spark, d, 0.9).ask_batch(asked).where("abstained").select("query_id", F.size("evidence").cast("long").alias("n_evidence"))


def relevance(spark, d) -> DataFrame:
    """Which texts hold which questions, kept."""
    return index.kept(retrieval.containing(documents(spark, d), questions(spark, d).select("query_id", "text")), "relevance")


@query(Q.relevance_pairs)
def relevance_pairs(spark, d):
    return relevance(spark, d)


@query(Q.retrieval_metrics)
def retrieval_metrics(spark, d):
    return rounded(evaluate.macro_average(evaluate.retrieval_by_question(bm25_hits(spark, d), relevance(spark, d))))


@query(Q.route_ablation)
def route_ablation(spark, d):
    """Every set of routes, and all routes with a model that reranks what they find: their measures, side by side."""
    hits = routes(spark, d).withColumn("rank", F.col("pos")).withColumn("score", 1.0 / F.col("pos"))
    names = ("dense", "lexical", "overlap")
    runs = retrieval.route_sets(hits, names, 60, 20).select(F.col("route_set").alias("run"), "query_id", "segment_id", "rank")
    every = "+".join(names)
    better = adapters.rerank(runs.where(F.col("run") == every).drop("run"), document_segments(spark, d), questions(spark, d), adapters.hashing_reranker(), 20)
    runs = index.kept(runs.unionByName(better.select(F.lit(f"{every}+reranker").alias("run"), "query_id", "segment_id", F.col("place").alias("rank"))), "runs")
    return rounded(evaluate.macro_average(evaluate.retrieval_by_question(runs, relevance(spark, d), keys=("run",)), ("run",)))


@query(Q.granularity_grid)
def granularity_grid(spark, d):
    """Frames as what is searched, at four depths and by both aggregations, against the segment that a query's vector is of."""
    rows, asked = vector_rows(spark, d), vector_queries(spark, d)
    hits = retrieval.frame_grid(rows.withColumnRenamed("segment_id", "frame_id"), membership(rows), asked, 20, (20, 50, 100, 200))
    truth = asked.select("query_id", F.expr("query_id div 4").alias("segment_id"))
    measures = evaluate.macro_average(evaluate.retrieval_by_question(hits, truth, (1, 5), ("aggregation", "depth")), ("aggregation", "depth"))
    returned = hits.groupBy("aggregation", "depth", "query_id").agg(F.count(F.lit(1)).alias("n")).groupBy("aggregation", "depth").agg(F.min("n").alias("fewest"), F.avg("n").alias("mean_returned"), F.max("n").alias("most"))
    return rounded(measures.join(returned, ["aggregation", "depth"]))


@query(Q.metrics_by_type)
def metrics_by_type(spark, d):
    one = evaluate.retrieval_by_question(bm25_hits(spark, d), relevance(spark, d))
    kind = F.element_at(F.array(*map(F.lit, ("audio", "visual", "ocr", "multimodal"))), (F.col("query_id") % 4 + 1).cast("int"))
    return rounded(evaluate.macro_average(one.withColumn("question_type", kind), ("question_type",), rollup=True)).withColumn("question_type", F.coalesce("question_type", F.lit("all")))


@query(Q.answer_em_f1)
def answer_em_f1(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("prediction", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"), "prediction")
    return rounded(evaluate.answer_scores(pairs).select("conv_id", "turn", "exact_match", "token_f1"))


@query(Q.rank_delta)
def rank_delta(spark, d):
    hits = routes(spark, d)
    lexical = hits.where("route = 'lexical'").select("query_id", "segment_id", F.col("pos").alias("rank"))
    return rounded(evaluate.rank_delta(retrieval.fuse(hits, 60, 20).select("query_id", "segment_id", "rank"), lexical, relevance(spark, d)))


@query(Q.percentiles_linear)
def percentiles_linear(spark, d):
    return rounded(evaluate.percentiles(table(spark, d, "lineitem"), ("l_returnflag",), "l_extendedprice", linear={"p50": 0.5, "p90": 0.9, "p99": 0.99}), 4)


@query(Q.percentiles_nearest)
def percentiles_nearest(spark, d):
    return evaluate.percentiles(table(spark, d, "orders"), ("o_orderpriority",), "o_totalprice", nearest={"p95": 0.95, "p50": 0.5})


@query(Q.latency_report)
def latency_report(spark, d):
    return rounded(evaluate.latency_summary(table(spark, d, "events").select(F.col("event_type").alias("route"), F.col("value").alias("ms"))), 4)


# Coverage.


@query(Q.keyframe_coverage)
def keyframe_coverage(spark, d):
    out = audit.coverage(counted(event_hours(spark, d)))
    return rounded(out.select("video_id", "segments", "empty", "memberships", "mean", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "median", "p90"))


@query(Q.frame_gaps)
def frame_gaps(spark, d):
    e = event_hours(spark, d)
    return rounded(audit.frame_gaps(purchases(e).select("video_id", "timestamp"), videos(e)))


@query(Q.longest_zero_run)
def longest_zero_run(spark, d):
    return rounded(audit.longest_zero_run(counted(event_hours(spark, d))), 3)


@query(Q.boundary_reuse)
def boundary_reuse(spark, d):
    e = event_hours(spark, d)
    return rounded(audit.boundary_reuse(counted(e), purchases(e)))


@query(Q.near_dup_frames)
def near_dup_frames(spark, d):
    rows = vector_rows(spark, d).select(F.expr("segment_id div 25").alias("video_id"), F.col("segment_id").cast("double").alias("timestamp"), vectors.sign_hash(F.col("vector")).alias("phash"))
    return audit.adjacent_near_duplicates(rows, 28).select("video_id", "first", "second", F.col("distance").cast("long").alias("distance"))


@query(Q.exact_duplicates)
def exact_duplicates(spark, d):
    return audit.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query(Q.reuse_counts)
def reuse_counts(spark, d):
    twice = table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return twice.agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("reused"), F.count(F.lit(1)).alias("contents"), F.max("n").alias("most"))


@query(Q.histogram)
def frame_histogram(spark, d):
    return counted(event_hours(spark, d)).groupBy(F.col("n_frames").cast("long").alias("n_frames")).agg(F.count(F.lit(1)).alias("segments"))


@query(Q.supplement_plan)
def supplement_plan(spark, d):
    plan = audit.plan_supplement(counted(event_hours(spark, d)), 1)
    return plan.select("video_id", "ordinal", "timestamp", F.array_join("segment_ids", ",").alias("segment_ids"), F.array_join("targeted_segment_ids", ",").alias("targeted"))


@query(Q.supplement_totals)
def supplement_totals(spark, d):
    return audit.plan_totals(audit.plan_supplement(counted(event_hours(spark, d)), 2))


@query(Q.supplement_choice)
def supplement_choice(spark, d):
    # A video is a hundred vectors, attempts at twenty planned frames, but for the first: these are the known frames, of all videos.
    rows = vector_rows(spark, d).select("segment_id", vectors.sign_hash(F.col("vector")).alias("phash"))
    trials = rows.where("segment_id % 100 <> 0").select(F.expr("segment_id div 100").alias("video_id"), F.expr("(segment_id % 100) div 5").alias("ordinal"), (F.col("segment_id") % 5).alias("attempt"), F.col("segment_id").cast("double").alias("timestamp"), "phash")
    out = audit.choose_supplement_frames(trials, rows.where("segment_id % 100 = 0").select("phash"), 20)
    return out.select("video_id", "ordinal", "attempt", "timestamp", F.col("nearest").cast("long").alias("nearest"), "near_duplicate")


# Review log.


def decisions(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = event_hours(spark, d)
    w = Window.partitionBy("video_id").orderBy("us")
    action = F.when(F.col("event_type").isin("purchase", "signup"), "accept").when(F.col("event_type") == "error", "reject").otherwise("reopen")
    return e.select(F.col("video_id").alias("question_id"), "event_id", F.row_number().over(w).alias("sequence"), F.lag("event_id").over(w).alias("previous_event_id"), action.alias("action"), F.col("event_type"))


@query(Q.latest_decision)
def latest_decision(spark, d):
    out = review.latest_decisions(decisions(spark, d))
    return out.select("question_id", "event_id", "action", F.col("sequence").cast("long").alias("sequence"))


@query(Q.review_progress)
def review_progress(spark, d):
    questions_ = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    return review.progress(questions_, review.latest_decisions(decisions(spark, d)))


@query(Q.export_counts)
def export_counts(spark, d):
    questions_ = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    return review.export_summary(questions_, review.latest_decisions(decisions(spark, d)), 10)


@query(Q.exported)
def exported_questions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("question"))
    return review.export_accepted(c, review.latest_decisions(decisions(spark, d)))


@query(Q.next_question)
def next_question(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("question_type"), (F.col("c_acctbal") > 0).alias("answerable"))
    latest = review.latest_decisions(decisions(spark, d))
    return review.next_candidate(c, latest, 100, "BUILDING").unionByName(review.next_candidate(c, latest, 10**9)).unionByName(review.next_candidate(c, latest, 20, "unanswerable")).select("question_id")


@query(Q.review_requests)
def review_requests(spark, d):
    """A request on every user's log, of eight kinds, and some on unknown questions: what is appended and what refused."""
    latest = review.latest_decisions(decisions(spark, d))
    kind = F.col("question_id") % 8
    base = latest.select("question_id", kind.alias("kind"), "event_id")
    asked = base.unionByName(base.where("question_id % 3 = 0").withColumn("question_id", F.col("question_id") + 10**9))
    requests = asked.select(
        "question_id", F.col("question_id").alias("request_no"), F.when(F.col("kind").isin(0, 1, 7), "accept").when(F.col("kind").isin(2, 3, 4), "reject").otherwise("reopen").alias("action"), F.when(F.col("kind") == 4, F.col("event_id") - 1).otherwise(F.col("event_id")).alias("base_event_id"),
        F.when(F.col("kind").isin(2, 5), " ").otherwise("seen").alias("reason"), (F.col("kind") != 1).alias("playback"), F.col("question_id").alias("edited_question_id"), F.when(F.col("kind") == 7, F.lit("other")).otherwise("own").alias("edited_video_id"),
    )
    events, refused = review.append_decisions(requests, latest, 100, latest.select("question_id", F.lit("own").alias("video_id")))
    made = events.select("question_id", F.lit("").alias("refusal"), F.col("sequence").cast("long").alias("sequence"), F.col("previous_event_id"))
    return made.unionByName(refused.select("question_id", "refusal", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("previous_event_id")))


@query(Q.review_chain_violations)
def review_chain_violations(spark, d):
    # The log of one reviewer's session a user: event ids by time, every 97th event names another predecessor and every
    # 53rd has no known action.
    e = decisions(spark, d)
    log = event_hours(spark, d).select("event_id", F.col("event_id").alias("line_no"))
    lines = e.join(log, "event_id").select("line_no", "event_id", (F.col("line_no") + F.when(F.col("line_no") % 501 == 0, 1).otherwise(0)).alias("sequence"), F.when(F.col("event_id") % 97 == 0, F.lit(-1)).otherwise(F.col("previous_event_id")).alias("previous_event_id"), "question_id", F.when(F.col("event_id") % 53 == 0, "other").otherwise(F.col("action")).alias("action"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    return review.log_violations(lines, known).groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))


# Constraints.


def breaking(spark, d, *rules: int) -> DataFrame:
    return question_violations(spark, d).where(F.col("rule").isin(*rules))


@query(Q.breaking(3, 4))
def validate_enums(spark, d):
    return breaking(spark, d, 3, 4)


@query(Q.breaking(19, 20))
def validate_fk(spark, d):
    return breaking(spark, d, 19, 20)


@query(Q.breaking(2))
def validate_unique(spark, d):
    return breaking(spark, d, 2)


@query(Q.breaking(11, 12))
def split_leakage(spark, d):
    return breaking(spark, d, 11, 12)


@query(Q.type_imbalance)
def type_imbalance(spark, d):
    return question_summary(spark, d).where("kind = 'warning'")


@query(Q.left_anti)
def left_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query(Q.category_counts)
def category_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.cube("lang", F.col("quality").cast("string").alias("quality")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("quality", F.lit("all")).alias("quality"), "n")


@query(Q.range_coverage)
def range_coverage(spark, d):
    rows = [(1, [[0.0, 20.0]]), (2, [[0.0, 12.0], [10.0, 20.0]]), (3, [[1.0, 20.0]]), (4, [[0.0, 9.0], [9.4, 20.0]]), (5, [[0.0, 9.0], [9.6, 20.0]]), (6, [[5.0, 3.0]]), (7, [[0.0, 19.2]]), (8, [[10.0, 20.0], [0.0, 10.0]])]
    df = spark.createDataFrame(rows, "id int, ranges array<array<double>>")
    return df.select("id", F.array_join(validate.range_problems(F.col("ranges"), F.lit(20.0)), "; ").alias("problems"))


def question_lines(spark, d) -> DataFrame:
    """(line, raw): a question for each document. Of each forty most break a rule or two, by their id mod 40; 33, 34, 36 and 38 are
    verified and break none, with evidence in sound, images, writing, and sound and writing."""
    docs = documents(spark, d)
    i = F.col("segment_id")
    m, text_id = i % 40, i.cast("string")
    pick = lambda cases, other: F.coalesce(*(F.when(m.isin(*at), value) for at, value in cases), other)
    verified = m.isin(5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 25, *range(28, 40))
    kinds = pick([((3,), F.lit("smell")), ((30, 34, 35), F.lit("visual")), ((31, 36, 37), F.lit("ocr")), ((32, 38, 39), F.lit("multimodal"))], F.lit("audio"))
    at = F.array(F.when(m == 35, 6.0).otherwise(5.0)).alias("frame_timestamps")  # the segments have a frame at 5.0
    visual = F.when(m.isin(34, 35, 39), F.struct(F.lit("a sign").alias("human_observation"), at, (m != 39).alias("human_verified")))
    ocr = F.when(m.isin(36, 37, 38), F.struct(F.when(m == 37, " ").otherwise("EXIT").alias("text"), at, F.lit(True).alias("human_verified")))
    asr = F.when(verified & ~m.isin(28, 30, 31, 34, 35, 36, 37), F.struct(F.lit("said:").alias("quote"), F.array(text_id).alias("segment_ids"), F.lit(True).alias("human_verified")))
    unanswerable = m.isin(20, 27, 29)
    own = {
        "question_id": pick([((1,), F.lit(" ")), ((2,), F.lit("same"))], text_id),
        "question": F.when(m != 0, "what is said?"),
        "answer": F.when(m == 17, "").otherwise("a"),
        "answer_aliases": pick([((18,), F.array(F.lit("a"), F.lit(" "))), ((19,), F.array(F.lit("a"), F.lit("a")))], F.array(F.lit("a"))),
        "question_type": kinds,
        "video_id": pick([((13,), F.concat(F.lit("v"), i - 1))], F.concat(F.lit("v"), i)),
        "relevant_segment_ids": pick([((21, 27, 29), F.array().cast("array<string>")), ((22,), F.array(F.concat(F.lit("x"), text_id))), ((23,), F.array((i - 1).cast("string")))], F.array(text_id)),
        "evidence_start": pick([((24,), F.lit(9.0)), ((26,), F.lit(30.0))], F.lit(1.0)),
        "evidence_end": pick([((25, 26), F.lit(40.0))], F.lit(8.0)),
        "answerable": ~unanswerable,
        "verification_status": F.when(m == 4, "unsure").when(verified, "verified").otherwise("generated_candidate"),
        "annotation_source": F.when(m == 5, "").when(m == 6, "model").otherwise("human_review"),
        "reviewer_id": F.when(m != 7, "r"),
        "reviewed_at": F.when(m == 8, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+08:00"),
        "review_event_id": F.when(m != 9, "e"),
        "split": F.when(m == 10, "train").when(m.isin(12, 14), "development").when(m.isin(13, 15), "test"),
        "paraphrase_group_id": F.when(m.isin(14, 15), F.concat(F.lit("g"), F.expr("segment_id div 40"))),
        "modality_evidence": F.when(verified & (m != 28), F.struct(asr.alias("asr"), visual.alias("visual"), ocr.alias("ocr"))),
    }
    empty = F.when(unanswerable & (m != 27), F.lit("null")).otherwise(F.lit("1.0"))
    raw = F.to_json(F.struct(*(v.alias(k) for k, v in own.items())))
    # Unanswerable questions (but those of 27) have a null interval, which must be there.
    raw = F.when(empty == "null", F.replace(F.replace(raw, F.lit('"evidence_start":1.0'), F.lit('"evidence_start":null')), F.lit('"evidence_end":8.0'), F.lit('"evidence_end":null'))).otherwise(raw)
    raw = F.when(m == 16, F.replace(raw, F.lit('"answerable":true'), F.lit('"answerable":null'))).otherwise(raw)
    return docs.select((i + 1).alias("line"), raw.alias("raw"))


def question_segments(spark, d) -> DataFrame:
    i = F.col("segment_id")
    return documents(spark, d).select(i.cast("string").alias("segment_id"), F.concat(F.lit("v"), F.when(i % 40 == 13, i - 1).otherwise(i)).alias("video_id"), F.lit(0.0).alias("start_time"), F.lit(20.0).alias("end_time"), F.concat(F.lit("said: "), F.coalesce("text", F.lit(""))).alias("transcript"), F.array(F.struct(F.lit(5.0).alias("timestamp"))).alias("keyframes"))


@query(Q.question_violations)
def question_violations(spark, d):
    found = validate.violations(validate.parse_questions(question_lines(spark, d)), question_segments(spark, d))
    return found.select("line", F.col("rule").cast("long").alias("rule"), F.regexp_replace("message", r"\d+", "N").alias("message"))


@query(Q.frozen_split_violations)
def frozen_split_violations(spark, d):
    """Verified questions that a frozen set may not hold, as they have no split."""
    found = validate.violations(validate.parse_questions(question_lines(spark, d)), question_segments(spark, d), require_splits=True)
    return found.where("rule = 13").select("line", "message")


@query(Q.question_summary)
def question_summary(spark, d):
    counts = validate.summary(validate.parse_questions(question_lines(spark, d)))
    return counts.unionByName(validate.warnings(counts).select(F.lit("warning").alias("kind"), F.col("warning").alias("value"), F.lit(1).cast("long").alias("n")))


# Preparation.


@query(Q.round_robin)
def round_robin(spark, d):
    return prepare.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query(Q.prompt_batches)
def prompt_batches(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select(F.col("lang").alias("group"), "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("place"))
    return prepare.batches(rows, "doc_id", 6).groupBy("group", "batch_no", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(Q.budgeted_selection)
def budgeted_selection(spark, d):
    return rounded(prepare.budgeted(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 50_000.0, 40, ("p_retailprice", "p_partkey")).select("p_partkey", "total"), 3)


@query(Q.first_occurrences)
def first_occurrences(spark, d):
    seed, made = table(spark, d, "documents").where("doc_id % 2 = 0").select("text", "doc_id"), table(spark, d, "documents").where("doc_id % 2 = 1").select("text", "doc_id")
    both = seed.withColumn("part", F.lit(0)).unionByName(made.withColumn("part", F.lit(1)))
    return both.groupBy("text").agg(F.min(F.struct("part", "doc_id")).alias("f")).select(F.col("f.part").cast("long").alias("part"), F.col("f.doc_id").alias("doc_id"))


def question_rows(spark, d) -> DataFrame:
    """The whole benchmark texts, and each again with another end."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), F.col("text").alias("q"))
    once = b.select(F.concat(F.lit("q"), F.col("ordinal")).alias("question_id"), "ordinal", F.col("q").alias("question"))
    again = b.select(F.concat(F.lit("r"), F.col("ordinal")).alias("question_id"), (F.col("ordinal") + 1000).alias("ordinal"), F.concat(F.expr("left(q, char_length(q) - 4)"), F.lit("??")).alias("question"))
    return once.unionByName(again)


@query()
def near_dup_questions(spark, d):
    q = question_rows(spark, d)
    return prepare.similar_pairs(q).select("later", "earlier", "ratio")


@query()
def review_queue(spark, d):
    q = question_rows(spark, d)
    pairs = index.kept(prepare.similar_pairs(q), "pairs")
    near = index.kept(prepare.first_near(pairs, q), "near")
    rows = q.select("question_id", "ordinal", "question", F.substring("question", 1, 10).alias("answer"), F.element_at(F.array(F.lit("audio"), F.lit("multimodal"), F.lit("visual")), (F.col("ordinal") % 3 + 1).cast("int")).alias("question_type"), (F.col("ordinal") % 4 != 0).alias("answerable"), F.concat(F.lit("src"), F.col("ordinal") % 20).alias("video_id"), F.array((F.col("ordinal") % 100).cast("string")).alias("relevant_segment_ids"), (F.col("ordinal") % 100).cast("string").alias("source_segment_id"))
    frames = F.transform(F.sequence(F.lit(0), (F.col("segment_id") % 3).cast("int")), lambda k: F.struct((F.col("start_time") + k).alias("timestamp")))
    segs = document_segments(spark, d).withColumn("keyframes", F.when(F.col("segment_id") % 3 > 0, frames)).withColumn("segment_id", F.col("segment_id").cast("string"))
    flagged = index.kept(prepare.review_flags(rows, segs, near), "flagged")
    out = prepare.evidence_skeleton(flagged, segs).join(prepare.paraphrase_groups(pairs, q), "question_id", "left")
    evidence = F.col("modality_evidence")
    return out.select(
        "question_id", "queue_position", "question_type", "review_priority", F.array_join("review_flags", ",").alias("flags"), "paraphrase_group_id", F.md5(evidence["asr"]["quote"].cast("binary")).alias("quote_md5"),
        F.array_join(F.coalesce(evidence["visual"]["frame_timestamps"], evidence["ocr"]["frame_timestamps"]).cast("array<string>"), ",").alias("frame_times"), "unanswerable_reason", "video_duration",
    )


def split_questions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("v"), F.col("doc_id") % 200).alias("video_id"), F.element_at(F.array(*map(F.lit, validate.TYPES)), (F.col("doc_id") % 5 + 1).cast("int")).alias("question_type"), F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("p"), F.col("doc_id") % 7)).alias("paraphrase_group_id"))


@query(Q.video_components)
def video_components(spark, d):
    return prepare.group_components(split_questions(spark, d))


@query()
def split_search(spark, d):
    return prepare.assign_splits(split_questions(spark, d))


@query(Q.split_feasibility)
def split_feasibility(spark, d):
    q = split_questions(spark, d)
    n = F.regexp_extract("video_id", r"(\d+)", 1).cast("int")
    splits = q.select("video_id").distinct().select("video_id", F.when(n % 20 < 14, "development").when(n % 20 < 17, "validation").otherwise("test").alias("split"))
    return prepare.split_feasibility(q, splits, (*validate.TYPES, "absent"))


@query(Q.prompt_texts)
def prompt_texts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("audio", "visual", "multimodal"))), (F.col("turn") % 3 + 1).cast("int"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("place"), kind.alias("question_type"), F.col("text").alias("transcript"), F.col("role").alias("visual_caption"))
    parts = prepare.prompt_sources(rows).select("batch_id", F.from_json("sources", "array<struct<source_id: int, evidence: string>>").alias("s"))
    return parts.select("batch_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x["evidence"]), "|").cast("binary")).alias("md5"))


@query(Q.seed_fields)
def seed_fields(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array(F.concat(F.col("source"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).alias("relevant_segment_ids"))
    return prepare.seed_metadata(rows).select("doc_id", "video_id", "answerable", "verification_status")


@query(Q.review_contexts)
def review_contexts(spark, d):
    docs = table(spark, d, "documents")
    asked = docs.select(F.col("doc_id").alias("question_id"), F.col("source").alias("video_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("string"))).otherwise(F.array(F.lit("none"))).alias("relevant_segment_ids"))
    segs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("segment_id"), F.col("source").alias("video_id"), F.col("doc_id").cast("double").alias("start_time"), (F.col("doc_id") + 20.25).alias("end_time"), F.col("text").alias("transcript"), F.col("lang").alias("visual_caption"), F.array(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))).alias("keyframes"))
    return review.review_context(asked, segs).select("question_id", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"), F.array_join("frames", ",").alias("frames"))
