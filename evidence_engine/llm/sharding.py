"""Contiguous shards of near-equal bytes from global prefix sums. DataFrame functions only.

Rows are put in order of id by ranges; each range's total is one row of a small table, whose running sum
gives every range its place; a running sum within the range then places each row among all bytes. A row
whose middle lies in the k-th of n equal parts of all bytes goes to shard k, so shards are contiguous in
the order of ids and a cut is off its target by half a row at most.

Edge cases: a null text has size 1 and checksum 0; null ids come first; rows that agree in id, size and
checksum are interchangeable; a shard stays empty if a single row is larger than a whole share; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.shared import materialize


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): slot counts from 0 within the shard, in the order of ids."""
    text = F.col(text_col).cast("string")
    sized = df.select(F.col(id_col).alias("id"), text_size(text).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    order = ["id", "size", "text_crc32"]
    # The ranges rest on a sample, so they are fixed by writing them before anything is computed from them.
    ranged = materialize(sized.repartitionByRange(*order).select(*order, F.spark_partition_id().alias("part")), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    within = Window.partitionBy("part").orderBy(*order)
    end = F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        ranged.join(F.broadcast(places), "part")  # a row for each range
        .select(*order, "all_bytes", end.alias("end"), (F.col("n_before") + F.row_number().over(within) - 1).alias("at"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * end - size)) div (2 * all_bytes)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of df under path/shard=k, each shard in order of slot. Ids must be unique and not null."""
    place = assign_shards(df, n_shards, id_col, text_col).select(F.col("id").alias(id_col), F.col("shard"), F.col("slot"))
    df.join(place, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
