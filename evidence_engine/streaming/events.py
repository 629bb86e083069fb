"""The review log and media events as streams: windows with watermarks, and the latest decision of each question."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "20 seconds", slide: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in sliding windows; events later than the watermark are left out."""
    w = F.window("ts", length, slide)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_by_key(events: DataFrame, key: str = "question_id", value: str = "action", order: str = "sequence") -> DataFrame:
    """Emits (key, value, order) whenever a batch holds a later event of a key than any before it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(group, batches, state):
        held = state.get if state.exists else (None, -1)
        best = held
        for pdf in batches:
            if len(pdf):
                row = pdf.loc[pdf[order].idxmax()]
                if int(row[order]) > best[1]:
                    best = (str(row[value]), int(row[order]))
        if best != held:
            state.update(best)
            yield pd.DataFrame({key: [group[0]], value: [best[0]], order: [best[1]]})

    slim = events.select(F.col(key).cast("string").alias(key), F.col(value).cast("string").alias(value), F.col(order).cast("long").alias(order))
    return slim.groupBy(key).applyInPandasWithState(fold, f"{key} string, {value} string, {order} long", f"{value} string, {order} long", "update", GroupStateTimeout.NoTimeout)
