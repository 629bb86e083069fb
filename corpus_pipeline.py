"""From raw documents to packed sequences: quality rules, toxicity, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidence_engine.llm import bin_completion, quality_cascade, simhash_tiles, toxic_lexicon
from evidence_engine.llm.queries import learned_lexicon, tokenizer_path
from evidence_engine.llm.shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cascade.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_lexicon.keep_clean(docs, learned_lexicon(spark, docs, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_tiles.drop_near_duplicates(docs, simhash_tiles.near_copies(docs, shingle=5, similarity=0.8))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_completion.pack(docs, tokenizer_path("word_bpe_49k.json"), 4096, 1)


#: Each takes (spark, docs, sf_dir); docs are the rows that the stage before returned.
STAGES = [("quality", quality), ("toxicity", toxicity), ("simhash_dedup", dedup), ("packing", packing)]

#: Hashing, tokenizing and learning have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
