"""The append-only review log: its checks, its fold, progress, the next candidate, and appending to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("accept", "reject", "reopen")
#: What a join sends to every task at most; beyond it the rows meet by key.
BROADCAST_BYTES = 16 << 20


def log_violations(events: DataFrame, known: DataFrame | None = None, candidate_sha256: str | None = None) -> DataFrame:
    """(sequence_no, rule, message) of events(line_no, event_id, sequence, previous_event_id, question_id, action[,
    candidate_file_sha256]). The order of the log is that of line_no, its own sequence numbers are what is checked; the
    check of each against the line before goes by line number, so no task sees the whole log."""
    lines = events.withColumn("_id", F.coalesce(F.col("event_id").cast("string"), F.lit("")))
    twice = Window.partitionBy("_id").orderBy("line_no")
    chain = Window.partitionBy("question_id").orderBy("line_no")
    checked = lines.withColumn("_dup", F.row_number().over(twice) > 1).withColumn("_expected", F.lag("event_id").over(chain))
    before = events.select((F.col("line_no") + 1).alias("line_no"), F.col("sequence").alias("_before"))
    checked = checked.join(before, "line_no", "left")
    rules = [
        ("duplicate or empty event_id", (F.col("_id") == "") | F.col("_dup")),
        ("non-monotonic sequence", ~F.col("sequence").eqNullSafe(F.coalesce("_before", F.lit(0)) + 1)),
        ("broken question revision chain", ~F.col("previous_event_id").eqNullSafe(F.col("_expected"))),
        ("invalid action", ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))),
    ]
    if known is not None:
        checked = checked.join(known.select("question_id", F.lit(True).alias("_known")).distinct(), "question_id", "left")
        rules.insert(2, ("unknown question", F.col("_known").isNull()))
    if candidate_sha256 is not None:
        rules.insert(3, ("candidate SHA mismatch", ~F.col("candidate_file_sha256").eqNullSafe(F.lit(candidate_sha256))))
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message"))) for n, (m, c) in enumerate(rules, 1))))
    return checked.select("line_no", F.explode(found).alias("v")).select("line_no", "v.rule", "v.message")


def require_sound(violations: DataFrame) -> None:
    """Raises for the first line that breaks a rule."""
    first = violations.orderBy("line_no", "rule").first()
    if first:
        raise ValueError(f"review log line {first['line_no']}: {first['message']}")


def latest_decisions(events: DataFrame) -> DataFrame:
    """(question_id, event_id, action, sequence): the last event of each question, as one aggregate."""
    return events.groupBy("question_id").agg(F.max_by(F.struct("event_id", "action", "sequence"), "sequence").alias("e")).select("question_id", "e.*")


def progress(questions: DataFrame, latest: DataFrame) -> DataFrame:
    """accepted, rejected, pending (a reopened question is pending) and total."""
    both = questions.select("question_id").join(latest.select("question_id", "action"), "question_id", "left")
    done = lambda a: F.count_if(F.col("action") == a)
    return both.agg(done("accept").alias("accepted"), done("reject").alias("rejected"), (F.count(F.lit(1)) - done("accept") - done("reject")).alias("pending"), F.count(F.lit(1)).alias("total"))


def export_accepted(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates whose last action is accept; their order is that of their ordinal."""
    return candidates.join(latest.where("action = 'accept'").select("question_id"), "question_id", "left_semi")


def export_summary(candidates: DataFrame, latest: DataFrame, eligible_from: int = 100) -> DataFrame:
    """Here every question with an event counts as decided, reopened ones too."""
    both = candidates.select("question_id").join(latest.select("question_id", "action"), "question_id", "left")
    accepted = F.count_if(F.col("action") == "accept")
    return both.agg(accepted.alias("accepted"), F.count_if(F.col("action") == "reject").alias("rejected"), F.count_if(F.col("action").isNull()).alias("pending"), (accepted >= eligible_from).alias("formal_metric_eligible"))


def next_candidate(candidates: DataFrame, latest: DataFrame, after: int = -1, question_type: str | None = None) -> DataFrame:
    """The first undecided candidate(question_id, ordinal, question_type, answerable) after a place, going round."""
    left = candidates.join(latest.where("action in ('accept', 'reject')").select("question_id"), "question_id", "left_anti")
    if question_type == "unanswerable":
        left = left.where("not answerable")
    elif question_type:
        left = left.where(F.col("question_type") == question_type)
    return left.orderBy(F.col("ordinal") <= after, "ordinal").limit(1)


def append_decisions(requests: DataFrame, latest: DataFrame, last_sequence: int, candidates: DataFrame | None = None, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(question_id, action, base_event_id, reason, playback, request_no[, edited_question_id, edited_video_id]) ->
    (events to append, refusals).

    A request must be about a question of candidates(question_id, video_id), leave both ids as they are, and be made on
    the question's head event; of several for a question only the first can. Accepting needs playback and a row that is not
    among invalid(request_no), rejecting and reopening need a reason, and reopening needs an event before it."""
    head = latest.select("question_id", F.col("event_id").alias("_head"))
    first = Window.partitionBy("question_id").orderBy("request_no")
    seen = requests.join(head, "question_id", "left").withColumn("_n", F.row_number().over(first))
    known = F.lit(True)
    if candidates is not None:
        own = candidates.select("question_id", F.col("video_id").alias("_video")).dropDuplicates(["question_id"])
        seen, known = seen.join(own.withColumn("_known", F.lit(True)), "question_id", "left"), F.col("_known").isNotNull()
    if invalid is not None:
        seen = seen.join(invalid.select("request_no", F.lit(True).alias("_invalid")).distinct(), "request_no", "left")
    changed = F.lit(False)
    if "edited_question_id" in requests.columns:
        changed = changed | ~F.col("edited_question_id").eqNullSafe(F.col("question_id"))
    if "edited_video_id" in requests.columns and candidates is not None:
        changed = changed | ~F.col("edited_video_id").eqNullSafe(F.col("_video"))
    action, blank_reason = F.col("action"), F.coalesce(F.trim("reason"), F.lit("")) == ""
    why = (
        F.when(~known | ~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "400 unknown question or action")
        .when((action != "accept") & blank_reason, F.concat(F.lit("400 "), action, F.lit(" needs a reason")))
        .when((action != "reopen") & changed, "400 question_id and video_id must not change")
        .when((action == "accept") & ~F.coalesce("playback", F.lit(False)), "400 accept needs playback")
        .when((action == "reopen") & F.col("_head").isNull(), "409 nothing to reopen")
        .when(~F.col("base_event_id").eqNullSafe(F.col("_head")) | (F.col("_n") > 1), "409 stale base event")
    )
    if invalid is not None:
        why = why.when((action == "accept") & F.col("_invalid").isNotNull(), "400 accepted annotation is invalid")
    judged = seen.withColumn("refusal", why)
    order = Window.orderBy("request_no")  # one batch of requests of reviewers
    fresh = judged.where("refusal is null").withColumn("sequence", F.lit(last_sequence) + F.row_number().over(order))
    events = fresh.select(F.sha2(F.concat_ws("|", "question_id", F.col("sequence").cast("string"), "action"), 256).alias("event_id"), "sequence", F.col("_head").alias("previous_event_id"), "question_id", "action", "reason", "request_no")
    return events, judged.where("refusal is not null").select("request_no", "question_id", "refusal")


def review_context(candidates: DataFrame, segments: DataFrame, most_frames: int = 8) -> DataFrame:
    """(question_id, evidence, frames) for candidates(question_id, video_id, relevant_segment_ids): the texts of the known relevant
    segments, or of the video's first two without any, and their first frames."""
    named = candidates.select("question_id", F.posexplode("relevant_segment_ids").alias("at", "segment_id")).join(segments.drop("video_id"), "segment_id")
    first = Window.partitionBy("video_id").orderBy("start_time", "segment_id")
    # The limit is on the row number itself, so each task keeps two of a video before texts are shuffled.
    two = segments.withColumn("at", F.row_number().over(first)).where(F.col("at") <= 2).withColumn("at", F.col("at") - 1)
    size = two.agg(F.sum(F.octet_length(F.to_json(F.struct(*two.columns))))).first()[0] or 0
    bare = candidates.join(named.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "video_id")
    other = bare.join(F.broadcast(two) if size <= BROADCAST_BYTES else two, "video_id").drop("video_id")
    shown = named.unionByName(other.select(named.columns))
    text = F.concat(F.lit("["), F.col("segment_id"), F.lit("] "), F.format_string("%.1f-%.1fs", F.bround("start_time", 1), F.bround("end_time", 1)), F.lit("\nASR: "), F.coalesce("transcript", F.lit("")), F.lit("\n视觉描述: "), F.coalesce("visual_caption", F.lit("")))
    frames = F.coalesce(F.transform("keyframes", lambda k: k["path"]), F.array().cast("array<string>"))
    rows = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("t"), frames.alias("f")))).alias("r"))
    return rows.select("question_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("evidence"), F.slice(F.flatten(F.transform("r", lambda x: x["f"])), 1, most_frames).alias("frames"))
