"""Manifests: what a written table is, and whether it still is that."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIMILARITY = "cosine of unit vectors, exact"
VERSION = 2


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows in any order: sums of two row hashes, so nothing is sorted or gathered."""
    packed = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    sums = rows.select(packed.alias("r")).select(F.xxhash64("r").cast("decimal(38,0)").alias("a"), F.xxhash64(F.reverse("r")).cast("decimal(38,0)").alias("b"))
    n, a, b = sums.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    import hashlib

    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def index_spec(vectors: DataFrame) -> dict:
    """Dimension and count of (segment_id, vector); vectors of several sizes or repeated ids raise."""
    low, high, n, ids = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count(F.lit(1)), F.count_distinct("segment_id")).first()
    if not n or low != high or n != ids:
        raise ValueError(f"not an index: {n} rows, {ids} ids, sizes {low} to {high}")
    return {"dimension": low, "count": n, "sha256": content_hash(vectors)}


def build_manifest(segments: DataFrame, indexes: dict[str, DataFrame], models: dict[str, str]) -> dict:
    return {"schema_version": VERSION, "segment_count": segments.count(), "segments_sha256": content_hash(segments), "models": models, "similarity": SIMILARITY, "indexes": {k: index_spec(v) for k, v in sorted(indexes.items())}}


def validate_manifest(manifest: dict | None, segments: DataFrame, indexes: dict[str, DataFrame], models: dict[str, str]) -> dict:
    """The cheap checks come first; the first that fails raises."""
    if manifest is None:
        raise ValueError("no manifest")
    if manifest.get("schema_version") != VERSION:
        raise ValueError("unsupported manifest version")
    if manifest.get("models") != models:
        raise ValueError("manifest models differ")
    if manifest.get("similarity") != SIMILARITY:
        raise ValueError("manifest similarity differs")
    if set(manifest.get("indexes", {})) != set(indexes):
        raise ValueError("manifest names other indexes")
    if manifest.get("segment_count") != segments.count():
        raise ValueError("segment count differs")
    if manifest.get("segments_sha256") != content_hash(segments):
        raise ValueError("segments differ")
    for name, vectors in indexes.items():
        if manifest["indexes"][name] != index_spec(vectors):
            raise ValueError(f"index {name} differs")
    return manifest


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Never overwrites: an equal one is left, a different one raises."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    found = read_manifest(spark, path)
    if found is None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    elif found != json.loads(text):
        raise ValueError(f"{path} holds another manifest")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return None
    return json.loads(row[0]) if row else None


def session_manifest(candidates: DataFrame, reviewer_id: str, created_at: str, guide_sha256: str | None = None) -> dict:
    """What a review session rests on; write_manifest() keeps it from being replaced by another."""
    return {"schema_version": 1, "created_at": created_at, "status": "formal_human_review_session", "reviewer_id": reviewer_id, "candidate_sha256": content_hash(candidates), "candidate_count": candidates.count(), "annotation_guide_sha256": guide_sha256, "formal_metric_eligible": False}
