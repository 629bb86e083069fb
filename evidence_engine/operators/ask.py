"""Questions in batches: recall, fusion, reranking, abstention, answers with evidence."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import blank, searchable_text, strip, token_overlap, tokenize
from evidence_engine.operators import adapters, retrieval
from evidence_engine.sources import index

# Fixed value: the answer when the evidence doesn't do.
ABSTENTION = "根据当前视频内容无法确定。"


class Retriever(Protocol):
    name: str

    def search(self, queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
        """queries(query_id, query) -> (query_id, segment_id, score, rank)."""


#: (query, searchable text) -> score as a Column expression, or the recipe of a model that scores pairs.
Reranker = Callable[[Column, Column], Column] | adapters.Recipe
#: (segment_id, start, end, transcript, caption) of the best segment -> answer, or how a model is asked for it.
Generator = Callable[[Column, Column, Column, Column, Column], Column] | adapters.Generation


@dataclass(frozen=True)
class Lexical:
    name: str = "lexical"

    def search(self, queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
        corpus = segments.select("segment_id", searchable_text(F.col("transcript"), F.col("visual_caption")).alias("text"))
        return retrieval.lexical_search(corpus, queries, k)


@dataclass(frozen=True)
class Dense:
    """vectors(segment_id, vector), and encode: queries -> (query_id, vector)."""

    vectors: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    name: str = "dense"

    def search(self, queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
        return retrieval.dense_search(self.vectors, self.encode(queries), k)


def overlap_reranker(query: Column, text: Column) -> Column:
    return token_overlap(tokenize(query), tokenize(text))


def first_evidence(segment_id: Column, start: Column, end: Column, transcript: Column, caption: Column) -> Column:
    body = F.when(~blank(transcript), strip(transcript)).when(~blank(caption), strip(caption))
    said = F.concat(body, F.lit("（证据："), segment_id, F.format_string("，%.1f–%.1f秒）", F.bround(start, 1), F.bround(end, 1)))
    return F.coalesce(said, F.lit(ABSTENTION))


@dataclass
class Pipeline:
    retrievers: list[Retriever]
    reranker: Reranker = overlap_reranker
    generator: Generator = first_evidence
    recall_top_k: int = 20
    fusion_top_k: int = 20
    rerank_top_k: int = 3
    rrf_k: int = 60
    minimum_rerank_score: float = 0.20
    allow_abstention: bool = True
    route_top_k: dict[str, int] = field(default_factory=dict)
    segments: DataFrame | None = None

    @classmethod
    def configured(cls, settings: Mapping[str, Any], retrievers: list[Retriever], **more) -> Pipeline:
        """A pipeline of config.settings(); routes by name: lexical, dense, vision."""
        of = {"lexical": "sparse_top_k", "dense": "text_top_k", "vision": "vision_top_k"}
        k = {r.name: settings[f"retrieval.{of[r.name]}"] for r in retrievers if r.name in of}
        own = {x: settings[f"retrieval.{x}"] for x in ("fusion_top_k", "rerank_top_k", "rrf_k")} | {x: settings[f"generation.{x}"] for x in ("minimum_rerank_score", "allow_abstention")}
        return cls(retrievers, route_top_k=k, **(own | more))

    def __post_init__(self) -> None:
        if not self.retrievers:
            raise ValueError("at least one retriever is required")
        if min(self.recall_top_k, self.fusion_top_k, self.rerank_top_k, self.rrf_k, *self.route_top_k.values()) <= 0:
            raise ValueError("the k values must be positive")

    def build(self, segments: DataFrame) -> Pipeline:
        if segments.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError("segment_id must be unique")
        self.segments = segments
        return self

    def _built(self) -> DataFrame:
        if self.segments is None:
            raise RuntimeError("call build() first")
        return self.segments

    def warmup(self, query: str = "video content") -> None:
        segments = self._built()
        if segments.limit(1).count() == 0:
            raise ValueError("no segments to search")
        queries = segments.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
        for r in self.retrievers:
            r.search(queries, segments, 1).count()

    def recall(self, queries: DataFrame) -> DataFrame:
        segments, out = self._built(), None
        for r in self.retrievers:
            hits = r.search(queries, segments, self.route_top_k.get(r.name, self.recall_top_k)).select("query_id", F.lit(r.name).alias("route"), F.col("rank").alias("pos"), "segment_id", "rank")
            out = hits if out is None else out.unionByName(hits)
        return out

    def _asked(self, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", strip(F.col("query")).alias("query"))
        return asked.withColumn("query", F.when(F.coalesce("query", F.lit("")) != "", F.col("query")).otherwise(F.raise_error(F.lit("query must not be empty"))))

    def _fused(self, hits: DataFrame) -> DataFrame:
        return retrieval.fuse(hits, self.rrf_k, self.fusion_top_k).select("query_id", "segment_id", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank"))

    def _ranked(self, asked: DataFrame, fused: DataFrame) -> DataFrame:
        text = searchable_text(F.col("transcript"), F.col("visual_caption"))
        if isinstance(self.reranker, adapters.Recipe):
            fused = adapters.rerank_pairs(fused, self._built(), asked, self.reranker)
        scored = fused.join(self._built(), "segment_id").join(asked, "query_id")
        if not isinstance(self.reranker, adapters.Recipe):
            scored = scored.withColumn("rerank_score", self.reranker(F.col("query"), text))
        w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc(F.round("fused_score", 9)), "fused_rank")
        return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= self.rerank_top_k)

    def evidence(self, queries: DataFrame) -> DataFrame:
        """(query_id, place, segment columns, fused_score, rerank_score): the best segments, also of questions that abstain."""
        asked = self._asked(queries)
        return self._ranked(asked, index.kept(self._fused(self.recall(asked)), "fused"))

    def ask_batch(self, queries: DataFrame) -> DataFrame:
        """(query_id, answer, abstained, evidence): a row for every question, whatever it finds. Without abstention, questions
        with any evidence are answered by their best."""
        return self._answered(queries, self.evidence(queries))

    def _answered(self, queries: DataFrame, best: DataFrame) -> DataFrame:
        item = F.struct("place", "segment_id", "video_id", "start_time", "end_time", "transcript", "visual_caption", "fused_score", "rerank_score")
        found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))  # rerank_top_k items each
        first = F.col("evidence")[0]
        enough = first["rerank_score"] >= self.minimum_rerank_score if self.allow_abstention else first.isNotNull()
        sure = F.coalesce(enough, F.lit(False))
        none = F.slice("evidence", 1, 0)
        out = queries.select("query_id", "query").join(found, "query_id", "left")
        if isinstance(self.generator, adapters.Generation):
            shown = best if "keyframes" in best.columns else best.withColumn("keyframes", F.lit(None).cast("array<struct<path:string>>"))
            shown = shown.join(found.where(sure).select("query_id"), "query_id", "left_semi")  # what abstains isn't asked
            out = out.join(adapters.generate(adapters.grounded_prompts(shown), self.generator).select("query_id", F.col("answer").alias("_told")), "query_id", "left")
            told = F.col("_told")
        else:
            told = self.generator(*(first[c] for c in ("segment_id", "start_time", "end_time", "transcript", "visual_caption")))
        kind = found.schema["evidence"].dataType.simpleString()
        return out.select("query_id", "query", F.when(sure, told).otherwise(ABSTENTION).alias("answer"), (~sure).alias("abstained"), F.when(sure, F.col("evidence")).otherwise(F.coalesce(none, F.array().cast(kind))).alias("evidence"))

    def timed(self, queries: DataFrame) -> tuple[list, dict[str, float]]:
        """ask_batch()'s rows, and the milliseconds of recall, fusion, rerank, generation and in total. For that the stages run one
        after the other, each kept until the next has run; ask_batch() leaves their order to Spark."""
        marks, kept = [time.perf_counter()], []

        def done(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            kept[-1].count()
            marks.append(time.perf_counter())
            return kept[-1]

        try:
            asked = self._asked(queries)
            hits = done(self.recall(asked))
            best = done(self._ranked(asked, done(self._fused(hits))))
            rows = self._answered(queries, best).collect()  # a batch that someone waits for
        finally:
            for df in kept:
                df.unpersist()
        marks.append(time.perf_counter())
        spans = dict(zip(("recall", "fusion", "rerank", "generation"), (1000 * (b - a) for a, b in zip(marks, marks[1:])), strict=True))
        return rows, spans | {"total": 1000 * (marks[-1] - marks[0])}

    def benchmark(self, queries: list[str], repeats: int = 5) -> DataFrame:
        """(query, run, stage, ms): the stages of each question, run 0 the first, cold one; for evaluate.latency_summary()."""
        spark, out = self._built().sparkSession, []
        for run in range(repeats):
            for query in queries:
                spans = self.timed(spark.createDataFrame([(0, query)], "query_id long, query string"))[1]
                out += [(query, run, stage, ms) for stage, ms in spans.items()]
        return spark.createDataFrame(out, "query string, run int, stage string, ms double")

    def ask(self, query: str) -> dict:
        """One question, with the latency of its stages."""
        spark: SparkSession = self._built().sparkSession
        if not query.strip():
            raise ValueError("query must not be empty")
        (row,), spans = self.timed(spark.createDataFrame([(0, query)], "query_id long, query string"))
        out = row.asDict(recursive=True)
        return {"answer": out["answer"], "abstained": out["abstained"], "evidence": [e | {"video_url": f"/api/videos/{e['video_id']}"} for e in out["evidence"]], "latency_ms": spans}

    def video_path(self, video_id: str) -> str | None:
        found = self._built().where(F.col("video_id") == video_id).orderBy("start_time", "segment_id").select("source_path").first()
        return found[0] if found else None


def hashing_encoder(dimension: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A model-free encoder: hashed token counts, for tests and as a stand-in for a pandas UDF with a model."""

    def encode(rows: DataFrame) -> DataFrame:
        key, text = rows.columns[:2]
        flat = rows.select(key, F.explode(tokenize(F.col(text))).alias("t")).groupBy(key, F.pmod(F.xxhash64("t"), F.lit(dimension)).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        return flat.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("vector"))

    return encode


def demo_segments(spark: SparkSession) -> DataFrame:
    rows = [("demo_0000", "demo", "demo.mp4", 0.0, 20.0, "The host introduces a retrieval system for video.", "A slide with a diagram"), ("demo_0001", "demo", "demo.mp4", 15.0, 35.0, "Then the ranking of evidence is explained.", "A chart of scores")]
    return spark.createDataFrame(rows, "segment_id string, video_id string, source_path string, start_time double, end_time double, transcript string, visual_caption string")


def predictions(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", "answer", "abstained", F.transform("evidence", lambda e: e["segment_id"]).alias("evidence_ids"))
