"""Windows over media time and what falls into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import blank, strip


def build_windows(videos: DataFrame, window: float = 20.0, overlap: float = 5.0, key: str = "video_id", duration: str = "duration") -> DataFrame:
    """(video_id, ordinal, segment_id, start_time, end_time): windows up to the first that reaches the end."""
    if window <= 0 or not 0 <= overlap < window:
        raise ValueError("window must be positive and overlap at least 0 and less than it")
    step = window - overlap
    d = F.when(F.col(duration) > 0, F.col(duration)).otherwise(F.raise_error(F.lit("a duration must be positive")))
    last = F.greatest(F.lit(0), F.ceil((d - window) / step)).cast("int")
    at = videos.select(key, d.alias("_d"), F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start = F.col("ordinal") * F.lit(step)
    return at.select(key, "ordinal", F.format_string("%s_%04d", F.col(key).cast("string"), F.col("ordinal")).alias("segment_id"), F.round(start, 3).alias("start_time"), F.round(F.least(start + window, F.col("_d")), 3).alias("end_time"))


def interval_join(windows: DataFrame, items: DataFrame, starts: str, ends: str, key: str = "video_id", bucket: float = 20.0) -> DataFrame:
    """Inner join of windows and items of a video that overlap strictly. Both are dealt to time buckets, so a long
    video is many equal keys' work; a pair is kept in the first bucket that it shares, once."""
    floor = lambda c: F.floor(c / bucket).cast("long")
    w = windows.withColumn("_b", F.explode(F.sequence(floor(F.col("start_time")), floor(F.col("end_time")))))
    i = items.withColumn("_b", F.explode(F.sequence(floor(F.col(starts)), floor(F.col(ends)))))
    met = w.join(i, [key, "_b"]).where((F.col(starts) < F.col("end_time")) & (F.col(ends) > F.col("start_time")))
    return met.where(F.col("_b") == F.greatest(floor(F.col("start_time")), floor(F.col(starts)))).drop("_b")


def point_join(windows: DataFrame, items: DataFrame, at: str, key: str = "video_id", bucket: float = 20.0) -> DataFrame:
    """Inner join of windows and points of a video with start <= point < end."""
    floor = lambda c: F.floor(c / bucket).cast("long")
    w = windows.withColumn("_b", F.explode(F.sequence(floor(F.col("start_time")), floor(F.col("end_time")))))
    i = items.withColumn("_b", floor(F.col(at)))
    return w.join(i, [key, "_b"]).where((F.col(at) >= F.col("start_time")) & (F.col(at) < F.col("end_time"))).drop("_b")


def clean_timed_text(chunks: DataFrame) -> DataFrame:
    """Speech chunks with both times, in order, and text that isn't blank, stripped."""
    return chunks.where(F.col("start").isNotNull() & (F.col("end") > F.col("start")) & ~blank(F.col("text"))).withColumn("text", strip(F.col("text")))


def with_transcripts(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """windows and transcript: the texts of spans(video_id, ord, start, end, text) that overlap, in the order of ord."""
    met = interval_join(windows.select("video_id", "segment_id", "start_time", "end_time"), spans.where(~blank(F.col("text"))), "start", "end")
    texts = met.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("transcript"))
    return windows.join(texts, "segment_id", "left").withColumn("transcript", F.coalesce("transcript", F.lit("")))


def with_keyframes(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """windows, keyframes and visual_caption from frames(video_id, timestamp, path, caption)."""
    met = point_join(windows.select("video_id", "segment_id", "start_time", "end_time"), frames, "timestamp")
    kept = met.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "path", "caption"))).alias("keyframes"))
    captions = F.filter(F.transform("keyframes", lambda k: strip(k["caption"])), lambda c: c != "")
    return windows.join(kept, "segment_id", "left").withColumn("visual_caption", F.coalesce(F.array_join(captions, " "), F.lit("")))


def scene_candidates(signal: DataFrame, threshold: float = 0.22) -> DataFrame:
    """signal(video_id, timestamp, histogram array<double>, sharpness): samples that differ from the one before.

    change is the Bhattacharyya distance to the previous sample's histogram, 1 for the first; the score adds a
    twentieth of log(1 + sharpness)."""
    w = Window.partitionBy("video_id").orderBy("timestamp")
    before = F.lag("histogram").over(w)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    near = total(F.zip_with("histogram", "_before", lambda x, y: F.sqrt(x * y))) / F.sqrt(total(F.col("histogram")) * total(F.col("_before")))
    change = F.when(F.col("_before").isNull(), 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - near)))
    out = signal.withColumn("_before", before).withColumn("change", change).withColumn("score", F.col("change") + F.log1p("sharpness") / 20)
    return out.where(F.col("_before").isNull() | (F.col("change") >= threshold)).drop("_before")


def suppress(candidates: Column, gap: float, most: Column) -> Column:
    """Of array<struct<score, timestamp, ...>> the best that are at least gap apart, taken by score (ties: earlier), in
    the order of time; at most `most` of them."""
    ranked = F.array_sort(candidates, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1).otherwise(0))
    empty = F.slice(candidates, 1, 0)
    kept = F.aggregate(ranked, empty, lambda acc, c: F.when((F.size(acc) < most) & F.forall(acc, lambda k: F.abs(k["timestamp"] - c["timestamp"]) >= gap), F.concat(acc, F.array(c))).otherwise(acc))
    return F.array_sort(kept, lambda a, b: F.when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1).otherwise(0))


def greedy_keyframes(candidates: DataFrame, durations: DataFrame, gap: float = 2.0, per_minute: float = 12.0) -> DataFrame:
    """(video_id, timestamp, score): candidates(video_id, timestamp, score) after suppression in each video."""
    most = F.greatest(F.lit(1), F.bround(F.col("duration") / 60 * per_minute).cast("int"))
    by_video = candidates.groupBy("video_id").agg(F.collect_list(F.struct("score", "timestamp")).alias("c")).join(durations.select("video_id", "duration"), "video_id")
    return by_video.select("video_id", F.explode(suppress(F.col("c"), gap, most)).alias("k")).select("video_id", "k.timestamp", "k.score")
