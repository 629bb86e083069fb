"""Vector functions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector raises."""
    n = norm(a)
    return F.when(n == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_by(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the element-wise mean of each key's vectors; a key's rows meet as partial sums by position."""
    flat = df.select(key, F.posexplode(vector).alias("_at", "_x")).groupBy(key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda e: e["_x"]).alias(vector))


def sign_hash(a: Column) -> Column:
    """64 bits: whether each of 64 components exceeds the median."""
    def packed(mid: Column) -> Column:
        median = (mid[31].cast("double") + mid[32].cast("double")) / 2
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x.cast("double") > median, 1).otherwise(0).cast("long")))

    return F.transform(F.array(F.array_sort(a)), packed)[0]  # a name for what is sorted, so that it is sorted once


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
