"""What the corpus operators share: table access, materialising, Arrow batches, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. If that is unset, the warehouse, unless it is on a
    local disk and Spark runs on more than one machine: then this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir")
        on_one = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not on_one and (found.startswith("file:") or "://" not in found):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM knows them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in a folder of this application, which is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/_intermediate/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        fs, path = _path(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of fresh_path()."""
    fs, found = _path(spark, path)
    fs.delete(found, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and the path."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    return written(df, label)[0]


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str, most: int = 1024, least: int = 1000) -> DataFrame:
    """rows joined to found, which has one row for each key and, in `weight`, how many rows have it.

    The `most` heaviest keys (of over `least` rows) are broadcast, so their rows stay where they are; the others, none of
    which has over one in `most` of all rows, meet by key. Both inputs are read twice and should be written tables."""
    hot = [r[0] for r in found.where(F.col(weight) > least).orderBy(F.desc(weight)).select(key).limit(most).collect()]
    values = found.drop(weight)
    if not hot:
        return rows.join(values, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(values.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key))


def text_slices(batches: Iterator[pa.RecordBatch], max_rows: int = 1024, max_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches (text in `column`) so that no slice holds more than max_bytes, single rows aside."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        at = 0
        while at < len(size):
            ends = np.cumsum(size[at : at + max_rows])
            n = max(1, int(np.searchsorted(ends, max_bytes, side="right")))
            yield batch.slice(at, n)
            at += n


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u[i]-v[i]: every node but the roots, and the least node of its component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def connected_components(edges: DataFrame, label: str, few: int = 1 << 16) -> DataFrame:
    """edges(u long, v long) -> (node, root): each node with a smaller one in its component, and the least of all.

    Alternates the large-star and small-star steps until nothing changes. Least neighbours are aggregates and, beyond a
    `few` links, reach the links by lookup(), so a node with very many neighbours is not gathered in one task. Each round
    is written to the shared folder, and the one before is deleted."""
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-edges")
    before = None
    while True:
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = after, [path]

        def to_least(links: DataFrame, least) -> DataFrame:
            """links with m, the least neighbour of u or (if smaller) what `least` makes of it."""
            found = links.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
            if after[0] <= few:
                return links.join(found.drop("n"), "u")
            (links, a), (found, b) = written(links, f"{label}-links"), written(found, f"{label}-least")
            old.extend((a, b))
            return lookup(links, found, "u", "n")

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both, F.least(F.col("u"), F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now, path = written(to_least(large, F.min("v")).select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct(), f"{label}-round")
        for done in old:
            forget(spark, done)
