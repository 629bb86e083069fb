"""Vector indexes as tables: built once, reused while they fit their segments, checked when they are read.

An index is a folder with `vectors` (Parquet: the key, the raw norm and the unit vector) and `about`, a manifest that is written
last, so a folder without it is an unfinished one. The checks are aggregates and anti joins; no vector reaches the driver."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.functions.vectors import norm, normalize
from evidence_engine.sources.manifest import index_spec, read_manifest, write_manifest


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. If that is unset, the warehouse, unless it is on a local
    disk and Spark runs on more than one machine: then this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir")
        on_one = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not on_one and (found.startswith("file:") or "://" not in found):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/_scratch/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what is small but dear, such as hits, is made once however often it is used, and
    Spark knows its size where it meets a large table."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_index(vectors: DataFrame, path: str, model: str, key: str = "segment_id") -> dict:
    """Writes vectors(key, vector) at unit length with their norms before. A null, empty or zero vector, one with a null or
    non-finite component, a repeated id or a second dimension raises, and leaves no manifest."""
    spark, length = vectors.sparkSession, norm(F.col("vector"))
    good = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()) & (length > 0) & (length < float("inf"))
    checked = F.when(F.coalesce(good, F.lit(False)), length).otherwise(F.raise_error(F.concat(F.lit("not a vector: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    vectors.select(key, checked.alias("raw_norm"), normalize(F.col("vector")).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    made = spark.read.parquet(f"{path}/vectors")
    about = {"model": model, "key": key} | index_spec(made.select(F.col(key).alias("segment_id"), "vector"))
    write_manifest(spark, about, f"{path}/about")
    return about


def load_index(spark: SparkSession, path: str, segments: DataFrame | None = None, model: str | None = None, key: str = "segment_id") -> DataFrame:
    """(key, raw_norm, vector) of an index, after its checks: there and finished, of this model and key, as it was written
    (dimension, count, ids, content), at unit length, and, with segments, of no unknown id. Fewer ids than segments are fine."""
    about = read_manifest(spark, f"{path}/about")
    if about is None:
        raise FileNotFoundError(f"{path} holds no finished index")
    if about.get("key") != key or model is not None and about.get("model") != model:
        raise ValueError(f"index of {about.get('model')} by {about.get('key')}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if index_spec(vectors.select(F.col(key).alias("segment_id"), "vector")) != {k: about.get(k) for k in ("dimension", "count", "sha256")}:
        raise ValueError(f"{path} is not what its manifest says")
    if vectors.where(F.abs(norm(F.col("vector")) - 1) > 1e-3).limit(1).count():
        raise ValueError("vectors are not of unit length")
    if segments is not None and vectors.join(segments.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the index has ids that no segment has")
    return vectors


def build_index(segments: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, model: str, force: bool = False, key: str = "segment_id") -> DataFrame:
    """The index of segments: the one at path if it loads and force is unset, else encode(segments) -> (key, vector), saved.
    What is there but doesn't load raises rather than being replaced; a folder without a manifest is written again."""
    spark = segments.sparkSession
    if segments.limit(1).count() == 0:
        raise ValueError("no segments to index")
    if force:
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    if force or read_manifest(spark, f"{path}/about") is None:
        save_index(encode(segments), path, model, key)
    return load_index(spark, path, segments, model, key)
