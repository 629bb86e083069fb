"""The queries of the corpus operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import bin_completion, bitsliced_topk, license_rules, lyndon_runs, maxent_lm, oracle, piece_codec, quality_cascade, sharding, simhash_tiles, token_archive, toxic_lexicon, warc_chunks, whitening
from evidence_engine.llm.shared import fresh_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitsliced_topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, 1)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc_chunks.write_archives(warc_chunks.plan_records(table(spark, sf_dir, "pages")), path)
    return warc_chunks.read_records(spark, path)


def learned_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxic_lexicon.Lexicon:
    return toxic_lexicon.learn(docs, table(spark, sf_dir, "labels").where(remainder() != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxic_lexicon.score(docs, learned_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(remainder() == 1, F.lit(True)).alias("held_out"), "text")
    return maxent_lm.train_and_score(spark, docs).withColumnRenamed("id", "doc_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licenses", "|").alias("licenses"))


def op11_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-archive")
    token_archive.write_archive(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_archive.read_archive(spark, path)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), components_kept=32))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_runs.scan(table(spark, sf_dir, "documents"), change=lyndon_runs.planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_license_scan": op10_license_scan,
    "op11_token_archive": op11_token_archive,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
