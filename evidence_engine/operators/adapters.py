"""Models that run in the workers: text encoders, rerankers, captioners and answer generators.

A model comes as a recipe: a function that loads it, which must be one that workers can unpickle. It is loaded by the first
batch that a worker process gets and stays for those after it, of later tasks too; with release=True a task gives it up when
it ends, however it ends. Rows go to the model in batches of like length, bounded by rows and by characters, so that padding
is small; a partition is sorted by length for that, which spills. No model is shipped; the engine's tests and queries plug
in ones that hash."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import blank, rerank_document, searchable_text

# What models are asked.
PAIR = "<Query>: %s\n<Document>: %s"
CAPTION = "Objectively describe the visible people, objects, actions, on-screen text, and scene. Do not infer information that is not visible."
GROUNDED = (
    "Answer the question using only the candidate video evidence below. Do not introduce external facts. If the evidence is insufficient, answer exactly: "
    "The current video evidence is insufficient to determine the answer. Give a concise answer and cite the supporting segment_id.\n\nQuestion: %s\n\nCandidate evidence:\n%s"
)
EVIDENCE = "[%s] Time %.1f-%.1f seconds\n%s"

_loaded: dict[str, Any] = {}


@dataclass(frozen=True)
class Recipe:
    """How workers get a model, and the name by which a process keeps it."""

    name: str
    load: Callable[[], Any]
    release: bool = False
    most_rows: int = 8
    most_characters: int = 1 << 16

    def model(self) -> Any:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]

    def give_up(self) -> None:
        model = _loaded.pop(self.name, None)
        if hasattr(model, "unload"):
            model.unload()


def _batches(recipe: Recipe, texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each a batch: padded to its longest it stays within the bounds, single texts aside."""
    at = 0
    while at < len(texts):
        end, longest = at, 0
        while end < len(texts) and end - at < recipe.most_rows:
            longest = max(longest, len(texts[end]))
            if end > at and longest * (end + 1 - at) > recipe.most_characters:
                break
            end += 1
        yield at, end
        at = end


def _run(recipe: Recipe, call: Callable[[Any, list[dict]], list], out: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, found = batch.to_pylist(), []
                for a, b in _batches(recipe, [r["_text"] for r in rows]):
                    made = call(recipe.model(), rows[a:b])
                    if len(made) != b - a:
                        raise ValueError(f"{recipe.name} gave {len(made)} results for {b - a} rows")
                    found += made
                kept = [c for c in batch.schema.names if not c.startswith("_")]
                yield batch.select(kept).append_column(out, pa.array(found, kind))
        finally:
            if recipe.release:
                recipe.give_up()

    return run


def _applied(rows: DataFrame, recipe: Recipe, call: Callable[[Any, list[dict]], list], out: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """rows (with a column _text, and others of _ for the call) and what the model makes of each, in place of these columns."""
    kept = [f for f in rows.schema if not f.name.startswith("_")]
    dealt = rows.withColumn("_length", F.char_length("_text")).sortWithinPartitions("_length").drop("_length")
    return dealt.mapInArrow(_run(recipe, call, out, arrow), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {out} {kind}")


def unwrap(output: Any) -> Any:
    """The features in a model's output: its image or text embeddings, its pooled output, the first token of its last hidden
    state, or the output itself."""
    for name in ("image_embeds", "text_embeds", "pooler_output"):
        if getattr(output, name, None) is not None:
            return getattr(output, name)
    hidden = getattr(output, "last_hidden_state", None)
    return output if hidden is None else hidden[:, 0]


def yes_probability(no: float, yes: float) -> float:
    """The share of yes in the softmax of two logits."""
    top = max(no, yes)
    a, b = math.exp(no - top), math.exp(yes - top)
    return b / (a + b)


def encode_texts(rows: DataFrame, recipe: Recipe, key: str = "segment_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """(key, vector): model.encode(texts, prompt) of the texts that aren't blank. Documents go without a prompt, queries with
    prompt="query"."""
    call = lambda model, part: [list(map(float, v)) for v in unwrap(model.encode([r["_text"] for r in part], prompt))]
    return _applied(rows.where(~blank(F.col(text))).select(key, F.col(text).alias("_text")), recipe, call, "vector", "array<double>", pa.list_(pa.float64()))


def rerank_pairs(hits: DataFrame, segments: DataFrame, queries: DataFrame, recipe: Recipe, out: str = "rerank_score") -> DataFrame:
    """hits with the score of model.logits(pairs), a (no, yes) for each pair of a query and a segment's document."""
    text = rerank_document(F.col("segment_id"), F.col("start_time"), F.col("end_time"), searchable_text(F.col("transcript"), F.col("visual_caption")))
    documents = segments.select("segment_id", text.alias("_document"))
    pairs = hits.join(documents, "segment_id").join(queries.select("query_id", F.col("query").alias("_query")), "query_id")
    asked = pairs.select(*hits.columns, F.format_string(PAIR, "_query", "_document").alias("_text"))
    call = lambda model, part: [yes_probability(no, yes) for no, yes in model.logits([r["_text"] for r in part])]
    return _applied(asked, recipe, call, out, "double", pa.float64())


def rerank(hits: DataFrame, segments: DataFrame, queries: DataFrame, recipe: Recipe, k: int) -> DataFrame:
    """The k best of each query by the model; equal scores keep the order that they came in (rank)."""
    scored = rerank_pairs(hits, segments, queries, recipe)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def grounded_prompts(evidence: DataFrame) -> DataFrame:
    """evidence(query_id, query, place, segment_id, start_time, end_time, transcript, visual_caption, keyframes) -> (query_id, query,
    prompt, images): the segments' texts and the paths of their frames, in the order of places."""
    said = F.format_string(EVIDENCE, "segment_id", F.bround("start_time", 1), F.bround("end_time", 1), searchable_text(F.col("transcript"), F.col("visual_caption")))
    paths = F.coalesce(F.transform("keyframes", lambda k: k["path"]), F.array().cast("array<string>"))
    rows = evidence.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("place", "segment_id", said.alias("said"), paths.alias("paths")))).alias("r"))  # a few of each question
    told = F.array_join(F.transform("r", lambda x: x["said"]), "\n\n")
    return rows.select("query_id", "query", F.format_string(GROUNDED, "query", told).alias("prompt"), F.flatten(F.transform("r", lambda x: x["paths"])).alias("images"))


@dataclass
class Generation:
    """How an answer is asked for: a recipe whose model has infer(prompt, images), images at most, and a test of their being
    there."""

    recipe: Recipe
    most_images: int = 6
    exists: Callable[[str], bool] = field(default=lambda path: __import__("os").path.exists(path))


def generate(prompts: DataFrame, how: Generation) -> DataFrame:
    """(query_id, query, answer) of grounded_prompts(): the first images that are there, in order, go with the prompt."""

    def call(model: Any, part: list[dict]) -> list[str]:
        return [model.infer(r["_text"], [p for p in r["_images"] if how.exists(p)][: how.most_images]) for r in part]

    rows = prompts.select("query_id", "query", F.col("prompt").alias("_text"), F.col("images").alias("_images"))
    return _applied(rows, how.recipe, call, "answer", "string", pa.string())


def caption_frames(frames: DataFrame, how: Generation) -> DataFrame:
    """frames, with model.infer() of the caption's prompt and each frame's image; a path that isn't there raises."""

    def call(model: Any, part: list[dict]) -> list[str]:
        missing = [r["path"] for r in part if not how.exists(r["path"])]
        if missing:
            raise FileNotFoundError(missing[0])
        return [model.infer(CAPTION, [r["path"]]) for r in part]

    return _applied(frames.withColumn("_text", F.lit(CAPTION)), how.recipe, call, "caption", "string", pa.string())


class HashingReranker:
    """Logits from the MD5 of a pair: (0, the log odds of a number between 0 and 1)."""

    def logits(self, pairs: list[str]) -> list[tuple[float, float]]:
        from hashlib import md5

        shares = ((int(md5(p.encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32) for p in pairs)
        return [(0.0, math.log(s / (1.0 - s))) for s in shares]


def hashing_reranker(**bounds: Any) -> Recipe:
    return Recipe("hashing-reranker", HashingReranker, **bounds)
