"""Constraints of a question set, as a table of violations (line, rule, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions.text import blank, strip, without_space

# The fields and domains of a question.
REQUIRED = ("question_id", "question", "answer", "answer_aliases", "question_type", "video_id", "relevant_segment_ids", "evidence_start", "evidence_end", "answerable", "verification_status", "annotation_source")
TYPES = ("audio", "visual", "ocr", "multimodal", "unknown_route")
STATUSES = ("verified", "generated_candidate")
SPLITS = ("development", "validation", "test")
REASONS = ("not_visible", "not_audible", "not_mentioned", "outside_video_scope", "insufficient_temporal_context", "ambiguous_entity")

_FRAMES = "frame_timestamps: array<double>, human_verified: boolean"
QUESTION = (
    "question_id string, question string, answer string, answer_aliases array<string>, question_type string, video_id string, relevant_segment_ids array<string>, "
    "evidence_start double, evidence_end double, answerable boolean, verification_status string, annotation_source string, reviewer_id string, reviewed_at string, "
    "review_event_id string, split string, paraphrase_group_id string, unanswerable_reason string, checked_time_ranges array<array<double>>, "
    f"modality_evidence struct<asr: struct<quote: string, segment_ids: array<string>, human_verified: boolean>, visual: struct<human_observation: string, {_FRAMES}>, ocr: struct<text: string, {_FRAMES}>>"
)


def parse_questions(lines: DataFrame) -> DataFrame:
    """lines(line, raw) -> line, missing (required fields that aren't there; a null one is), and the question's fields."""
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    return lines.select("line", F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)).alias("missing"), keys.alias("_keys"), F.from_json("raw", QUESTION).alias("q")).select("line", "missing", "_keys", "q.*")


def range_problems(ranges: Column, end: Column, slack: float = 0.5) -> Column:
    """Messages for array<array<double>> that should cover 0 to end without overlaps."""
    bad = F.exists(ranges, lambda r: ~F.coalesce((F.size(r) == 2) & (r[0] >= 0) & (r[0] < r[1]) & (r[1] <= end), F.lit(False)))
    order = F.array_sort(ranges)
    pairs = F.when(F.size(order) > 1, F.transform(F.sequence(F.lit(1), F.size(order) - 1), lambda i: F.element_at(order, (i + 1).cast("int"))[0] - F.element_at(order, i.cast("int"))[1])).otherwise(F.array().cast("array<double>"))
    gaps = F.exists(pairs, lambda g: g > slack) | (F.element_at(order, 1)[0] > slack) | (F.element_at(order, -1)[1] < end - slack)
    return F.when(bad, F.array(F.lit("checked_time_ranges contain an invalid range"))).otherwise(
        F.array_compact(F.array(F.when(F.exists(pairs, lambda g: g < 0), "checked_time_ranges overlap"), F.when(gaps, "verified unanswerable review must cover the full video")))
    )


def violations(questions: DataFrame, segments: DataFrame, require_splits: bool = False) -> DataFrame:
    """(line, rule, message) of parse_questions() against segments(segment_id, video_id, start_time, end_time, transcript,
    keyframes). A line without a required field has that one violation. Rules are numbered in the order of reports."""
    whole = questions.where(F.size("missing") == 0)
    missing = questions.where(F.size("missing") > 0).select("line", F.lit(1).alias("rule"), F.concat(F.lit("missing fields "), F.array_join("missing", ",")).alias("message"))
    verified = F.col("verification_status") == "verified"
    split = F.when(verified, F.col("split"))
    group = F.when(split.isNotNull() & ~blank(F.col("paraphrase_group_id")), F.col("paraphrase_group_id"))

    # Lines without a key get one of their own, so they don't meet in one task; keys are folded before they are joined.
    own = lambda key: F.struct(key.alias("k"), F.when(key.isNull(), F.col("line")).alias("line"))
    qid = strip(F.coalesce("question_id", F.lit("")))
    q = whole.select("*", own(F.when(qid != "", qid)).alias("_qid"), own(F.col("video_id")).alias("_video"), own(group).alias("_group"), split.alias("_split"))
    ends = segments.where("video_id is not null").groupBy(F.struct(F.col("video_id").alias("k"), F.lit(None).cast(q.schema["line"].dataType).alias("line")).alias("_video")).agg(F.max("end_time").alias("_video_end"))
    for key, name, value in (("_qid", "_first", F.min("line")), ("_video", "_video_split", F.min_by("_split", F.when(F.col("_split").isNotNull(), F.col("line")))), ("_group", "_group_split", F.min_by("_split", F.when(F.col("_split").isNotNull(), F.col("line"))))):
        q = q.join(q.where(F.col(f"{key}.k").isNotNull()).groupBy(key).agg(value.alias(name)), key, "left")
    q = q.join(ends, "_video", "left")
    named = q.select("line", F.col("video_id").alias("_v"), F.col("evidence_start").alias("_s"), F.col("evidence_end").alias("_e"), F.posexplode("relevant_segment_ids").alias("_at", "segment_id"))
    met = named.join(segments.withColumnRenamed("video_id", "_sv"), "segment_id", "left")
    frames = F.coalesce(F.transform("keyframes", lambda k: F.round(k["timestamp"].cast("double"), 3)), F.array().cast("array<double>"))
    apart = F.col("_sv").isNotNull() & ~(F.greatest("_s", "start_time") < F.least("_e", "end_time"))
    facts = met.groupBy("line").agg(
        F.array_sort(F.collect_list(F.when(F.col("_sv").isNull(), F.col("segment_id")))).alias("_unknown"),
        F.array_sort(F.collect_list(F.when(F.col("_sv") != F.col("_v"), F.col("segment_id")))).alias("_foreign"),
        F.array_sort(F.collect_list(F.when(apart, F.col("segment_id")))).alias("_apart"),
        F.flatten(F.collect_list(frames)).alias("_frames"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("_sv").isNotNull(), F.struct("segment_id", F.coalesce("transcript", F.lit(""))))))).alias("_texts"),
    )
    q = q.join(facts, "line", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    relevant, answerable = F.coalesce("relevant_segment_ids", none("string")), F.coalesce("answerable", F.lit(False))
    asr, visual, ocr = (F.col(f"modality_evidence.{x}") for x in ("asr", "visual", "ocr"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    source = F.array_join(F.transform(asr["segment_ids"], lambda i: F.coalesce(F.try_element_at("_texts", i), F.lit(""))), " ")
    valid_asr = yes(~blank(asr["quote"]) & (F.size(asr["segment_ids"]) > 0) & asr["human_verified"] & (F.size(F.array_except(asr["segment_ids"], relevant)) == 0) & F.contains(without_space(source), without_space(asr["quote"])))
    seen = lambda x: yes((F.size(x["frame_timestamps"]) > 0) & x["human_verified"] & F.forall(x["frame_timestamps"], lambda t: F.array_contains(F.coalesce("_frames", none("double")), F.round(t, 3)) & (t >= F.col("evidence_start")) & (t <= F.col("evidence_end"))))
    valid_visual, valid_ocr = seen(visual) & ~blank(visual["human_observation"]), seen(ocr) & ~blank(ocr["text"])
    aliases = F.col("answer_aliases")
    trimmed = F.transform(aliases, strip)
    interval = yes((F.col("evidence_start") >= 0) & (F.col("evidence_start") < F.col("evidence_end")))
    zone = F.coalesce(F.col("reviewed_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp("reviewed_at").isNotNull(), F.lit(False))
    claims = F.coalesce(asr.isNotNull() | visual.isNotNull() | ocr.isNotNull(), F.lit(False))
    m = lambda text: F.array(F.lit(text))
    each = lambda col, text: F.transform(F.coalesce(col, none("string")), lambda i: F.concat(F.lit(text), i))
    in_domain = lambda c, domain: F.coalesce(F.col(c).isin(*domain), F.lit(False))
    rules: list[tuple[Column, Column]] = [
        ((qid == "") | yes(F.col("line") > F.col("_first")), m("duplicate or empty question_id")),
        (~in_domain("question_type", TYPES), m("unsupported question_type")),
        (~in_domain("verification_status", STATUSES), m("unsupported verification_status")),
        (verified & blank(F.col("annotation_source")), m("verified item requires annotation_source")),
        (verified & ~in_domain("annotation_source", ("human_review",)), m("verified item annotation_source must be human_review")),
        (verified & blank(F.col("reviewer_id")), m("verified item requires reviewer_id")),
        (verified & ~zone, m("verified item requires timezone-aware reviewed_at")),
        (verified & blank(F.col("review_event_id")), m("verified item requires append-only review_event_id")),
        (split.isNotNull() & ~in_domain("split", SPLITS), m("invalid split")),
        (split.isNotNull() & (F.col("_video_split") != split), m("video leaks across splits")),
        (group.isNotNull() & (F.col("_group_split") != split), m("paraphrase group leaks across splits")),
        (verified & F.col("split").isNull() & F.lit(require_splits), m("verified item requires frozen split")),
        (F.col("answerable").isNull(), m("answerable must be boolean")),
        (answerable & blank(F.col("answer")), m("answerable item requires answer")),
        (
            F.lit(True),
            F.when(aliases.isNull() | F.exists(aliases, lambda a: F.coalesce(strip(a), F.lit("")) == ""), m("answer_aliases must be a list of non-empty strings"))
            .when(F.size(F.array_distinct(trimmed)) != F.size(aliases), m("answer_aliases must not contain duplicates"))
            .when(answerable & ~F.coalesce(F.array_contains(trimmed, strip(F.col("answer"))), F.lit(False)), m("answer_aliases must include the canonical answer"))
            .otherwise(none("string")),
        ),
        (~answerable & (F.size(relevant) > 0), m("unanswerable item must not contain relevant segments")),
        (answerable & (F.size(relevant) == 0), m("answerable item requires relevant segments")),
        (F.lit(True), each(F.col("_unknown"), "unknown segment ")),
        (F.lit(True), each(F.col("_foreign"), "segment of another video ")),
        (answerable & ~interval, m("invalid evidence interval")),
        (answerable & interval & verified & yes(F.col("evidence_end") > F.coalesce("_video_end", F.lit(0.0)) + 0.05), m("evidence interval exceeds actual video duration")),
        (answerable & interval, each(F.col("_apart"), "no overlap with the evidence interval: ")),
        (~answerable & (F.col("evidence_start").isNotNull() | F.col("evidence_end").isNotNull()), m("unanswerable evidence interval must be null")),
        (verified & F.col("modality_evidence").isNull(), m("verified item requires modality_evidence object")),
        (verified & ~answerable & claims, m("unanswerable item must not claim supporting modality evidence")),
        (verified & ~answerable & ~in_domain("unanswerable_reason", REASONS), m("verified unanswerable item requires a valid unanswerable_reason")),
        (verified & ~answerable, F.when(F.coalesce(F.size("checked_time_ranges"), F.lit(0)) <= 0, m("verified unanswerable item requires checked_time_ranges")).otherwise(range_problems(F.col("checked_time_ranges"), F.coalesce("_video_end", F.lit(0.0))))),
        (verified & answerable & (F.col("question_type") == "audio") & ~valid_asr, m("verified audio item requires ASR quote and segment_ids")),
        (verified & answerable & (F.col("question_type") == "visual") & ~valid_visual, m("verified visual item requires frame timestamps")),
        (verified & answerable & (F.col("question_type") == "ocr") & ~valid_ocr, m("verified OCR item requires OCR text and frame timestamps")),
        (verified & answerable & (F.col("question_type") == "multimodal") & (sum((v.cast("int") for v in (valid_asr, valid_visual, valid_ocr)), F.lit(0)) < 2), m("verified multimodal item requires at least two valid modality sources")),
    ]
    def numbered(n: int, msgs: Column) -> Column:
        return F.transform(msgs, lambda t: F.struct(F.lit(n).alias("rule"), t.alias("message")))

    found = F.flatten(F.array(*(F.when(yes(c), numbered(n, msgs)).otherwise(F.array().cast("array<struct<rule:int,message:string>>")) for n, (c, msgs) in enumerate(rules, 2))))
    return missing.unionByName(q.select("line", F.explode(found).alias("v")).select("line", "v.rule", "v.message"))


def summary(questions: DataFrame) -> DataFrame:
    """(kind, value, n): counts by type, status, split of verified rows and answerable; lines with missing fields don't count."""
    ok = questions.where(F.size("missing") == 0)
    parts = F.array(
        *(F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in (
            ("question_type", F.col("question_type")), ("verification_status", F.col("verification_status")),
            ("split", F.when(F.col("verification_status") == "verified", F.col("split"))), ("answerable", F.col("answerable").cast("string")),
        ))
    )
    return ok.select(F.explode(parts).alias("p")).select("p.*").where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def warnings(counts: DataFrame) -> DataFrame:
    """(warning) from summary()."""
    n = F.when(F.col("kind") == "question_type", F.col("n"))
    one = counts.agg((F.max(n) / F.sum(n)).alias("share"), F.sum(F.when((F.col("kind") == "verification_status") & (F.col("value") == "verified"), F.col("n"))).alias("verified"))
    return one.select(F.explode(F.array_compact(F.array(F.when(F.col("share") > 0.70, "question types are severely imbalanced (>70% in one type)"), F.when(F.coalesce("verified", F.lit(0)) == 0, "dataset contains no human-verified questions")))).alias("warning"))
