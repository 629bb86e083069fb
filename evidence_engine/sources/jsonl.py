"""JSON lines, CSV, video folders, and catalogues of open media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import blank, strip_markup, video_identifier

KEYFRAME = "struct<timestamp: double, path: string, caption: string, selection_source: string, described_by_vlm: boolean>"
SEGMENT = f"segment_id string, video_id string, source_path string, start_time double, end_time double, transcript string, visual_caption string, keyframes array<{KEYFRAME}>"
SEGMENT_KEYS = ("segment_id", "video_id", "source_path", "start_time", "end_time", "transcript", "visual_caption", "keyframes")
VIDEO_KINDS = "*.{mp4,mkv,mov,avi,webm,flv,m4v}"


#: Splits whose line counts are sent to every task; more of them meet their lines by key.
BROADCAST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw): the lines with their numbers from 1, blank ones left out after counting; a folder's files follow each other by
    name. Lines are counted by file and start of block, however Spark packs these into partitions, and a line's number is its
    place in its block and the lines before the block; no task sees all lines."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    few = len(spark.read.text(path).inputFiles()) <= BROADCAST_SPLITS // 16 and splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    met = lines.join(F.broadcast(splits) if few else splits, ["_file", "_block"])
    return met.select((F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias("line"), "raw").where(~blank(F.col("raw")))


def lenient_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The JSON objects of a file or folder; blank lines are passed over, and so are the numbers of lines."""
    read = spark.read.schema(schema) if schema else spark.read
    return read.option("mode", "FAILFAST").json(path)


def save_segments(segments: DataFrame, path: str) -> None:
    segments.select(*SEGMENT_KEYS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def segment_problems(lines: DataFrame) -> DataFrame:
    """(line, message) of lines(line, raw) that aren't valid segments."""
    parsed = lines.withColumn("s", F.from_json("raw", SEGMENT)).withColumn("k", F.json_object_keys("raw"))
    unknown = F.array_except("k", F.array(*map(F.lit, SEGMENT_KEYS)))
    message = (
        F.when(F.col("k").isNull(), "not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys "), F.array_join(unknown, ",")))
        .when(blank(F.col("s.segment_id")) | blank(F.col("s.video_id")), "empty identifier")
        .when(~F.coalesce((F.col("s.start_time") >= 0) & (F.col("s.start_time") < F.col("s.end_time")), F.lit(False)), "invalid time range")
    )
    return parsed.select("line", message.alias("message")).where("message is not null")


def load_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON lines; the first bad line raises."""
    lines = numbered_lines(spark, path)
    first = segment_problems(lines).orderBy("line").first()
    if first:
        raise ValueError(f"line {first['line']}: {first['message']}")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    frames = F.coalesce("keyframes", F.array().cast(f"array<{KEYFRAME}>"))
    frames = F.transform(frames, lambda k: F.struct(k["timestamp"].alias("timestamp"), k["path"].alias("path"), F.coalesce(k["caption"], F.lit("")).alias("caption"), F.coalesce(k["selection_source"], F.lit("scene_change_v1")).alias("selection_source"), F.coalesce(k["described_by_vlm"], F.lit(True)).alias("described_by_vlm")))
    rows = lines.select(F.from_json("raw", SEGMENT).alias("s")).select("s.*")
    return rows.select("segment_id", "video_id", "source_path", "start_time", "end_time", text("transcript"), text("visual_caption"), frames.alias("keyframes"))


def load_questions(spark: SparkSession, path: str, segments: DataFrame) -> DataFrame:
    """Evaluation questions: five fields, unique ids, at least one relevant segment, all of them known."""
    kinds = "question_id string, question string, answer string, relevant_segment_ids array<string>, question_type string"
    q = numbered_lines(spark, path).select("line", F.from_json("raw", kinds).alias("q")).select("line", "q.*")
    absent = [F.when(F.col(c).isNull(), c) for c in ("question_id", "question", "answer", "relevant_segment_ids", "question_type")]
    bad = q.withColumn("m", F.array_compact(F.array(*absent))).where((F.size("m") > 0) | blank(F.col("question_id")) | (F.size("relevant_segment_ids") == 0)).orderBy("line").first()
    if bad:
        raise ValueError(f"line {bad['line']}: missing or empty fields {bad['m']}")
    again = q.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if again:
        raise ValueError(f"duplicate question_id {again['question_id']}")
    lost = q.select("line", F.explode("relevant_segment_ids").alias("segment_id")).join(segments.select("segment_id"), "segment_id", "left_anti").orderBy("line").first()
    if lost:
        raise ValueError(f"line {lost['line']}: unknown segment {lost['segment_id']}")
    if not q.limit(1).count():
        raise ValueError("no questions")
    return q


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, video_id) of all videos under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", VIDEO_KINDS).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", video_identifier(name, F.col("path")).alias("video_id"))


def catalogue_filter(items: DataFrame, max_bytes: float, deny: tuple[str, ...] = (), licences: tuple[str, ...] = ("cc", "public domain")) -> DataFrame:
    """items(page_id, fetched, title, mime, size, licence): videos of at least 1 MB with an open licence and a Chinese title
    (two Han characters, no kana); the last of each page, ordered by size in `place`."""
    title: Column = strip_markup(F.col("title"))
    han = F.size(F.regexp_extract_all(title, F.lit("([一-鿿])"), F.lit(1)))
    open_licence = F.exists(F.array(*map(F.lit, licences)), lambda x: F.contains(F.lower("licence"), x))
    good = F.col("mime").startswith("video/") & F.col("size").between(1_000_000, max_bytes) & open_licence & (han >= 2) & ~title.rlike("[ぁ-ヿ]")
    for d in deny:
        good = good & ~F.contains(F.lower(title), F.lit(d.lower()))
    last = items.where(good).groupBy("page_id").agg(F.max_by(F.struct("title", "size", "licence"), "fetched").alias("i"))
    return last.select("page_id", strip_markup(F.col("i.title")).alias("title"), "i.size", "i.licence")
