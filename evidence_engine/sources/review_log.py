"""A durable review log: numbered files, each put there once, and snapshots of their fold.

Appending is to put the next numbered file, which only one of several writers can: the file is written by a name of its own and
then linked (local files) or renamed without overwriting (other file systems) to its number. A writer that comes too late
reads the log again and judges its requests anew, so a request on an event that is no longer the head is refused. A file
holds the events of one batch, in order; its number is that of its first event. Nothing is ever changed or removed.

A snapshot is a table of the last event of each question up to a number; the fold reads the latest snapshot and the files
after it. Snapshots are written beside the log and named last, so a half-written one is not found."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.operators import review, validate

EVENT = "event_id string, sequence long, previous_event_id string, question_id string, action string, reason string, reviewer_id string, reviewed_at string, candidate_file_sha256 string, candidate_before string, annotation_after string"
REQUEST = "question_id string, action string, base_event_id string, reason string, playback boolean, request_no long, edited_question_id string, edited_video_id string"
LATEST = "question_id string, event_id string, action string, sequence long"


class ReviewLog:
    """candidates: the question file as lines(line, raw); segments: what accepted rows are validated against."""

    def __init__(self, spark: SparkSession, path: str, candidates: DataFrame, segments: DataFrame) -> None:
        self.spark, self.path, self.segments = spark, path.rstrip("/"), segments
        parsed = validate.parse_questions(candidates)
        self.candidates = parsed.select("question_id", "video_id").join(candidates.select("raw", F.get_json_object("raw", "$.question_id").alias("question_id")), "question_id")
        ordered = candidates.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"])), 256))
        self.sha256 = ordered.first()[0]  # a file that people made

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith((".", "_"))) if fs.exists(path) else []

    def events(self, after: int = 0) -> DataFrame:
        """Events of a sequence over `after`; files that hold only earlier ones aren't read."""
        names = self._names("events")
        starts = [int(n.split(".")[0]) for n in names]
        kept = [n for n, following in zip(names, [*starts[1:], None]) if following is None or following > after + 1]
        if not kept:
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).json([f"{self.path}/events/{n}" for n in kept]).where(F.col("sequence") > after)

    def latest(self) -> DataFrame:
        """The last event of each question: the latest snapshot, and what came after."""
        marks = [int(n) for n in self._names("snapshots")]
        if not marks:
            return review.latest_decisions(self.events())
        before = self.spark.read.schema(LATEST).parquet(f"{self.path}/snapshots/{marks[-1]:012}")
        return review.latest_decisions(before.unionByName(self.events(marks[-1]).select(*before.columns)))

    def snapshot(self) -> int:
        """Folds the log into a snapshot; returns the sequence up to which it goes."""
        last = self.events().agg(F.max("sequence")).first()[0] or 0
        if last and f"{last:012}" not in self._names("snapshots"):
            own = f"{self.path}/.snapshot-{uuid.uuid4().hex}"
            self.latest().where(F.col("sequence") <= last).select(*(c.split()[0] for c in LATEST.split(", "))).write.parquet(own)
            fs, source = self._fs(own)
            _, target = self._fs(f"{self.path}/snapshots/{last:012}")
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
        return last

    def _put(self, number: int, text: str) -> bool:
        """Whether the file of this number is now this text; False if there is one already."""
        name, own = f"{self.path}/events/{number:012}.json", f"{self.path}/events/.{uuid.uuid4().hex}"
        fs, target = self._fs(name)
        fs.mkdirs(target.getParent())
        if fs.getScheme() == "file":
            source, end = (self._fs(p)[1].toUri().getPath() for p in (own, name))
            with open(source, "w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(source, end)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(source)
        out = fs.create(self._fs(own)[1], False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs(own)[1], target, no_options)
            return True
        except Exception:
            if not fs.exists(target):
                raise
            return False

    def _invalid(self, requests: list[dict], reviewer: str, at: str) -> DataFrame:
        """(request_no) of those whose row would break a rule once accepted."""
        lines = [(r["request_no"], json.dumps(self._accepted(r, reviewer, at, "pending"), ensure_ascii=False)) for r in requests if r["action"] == "accept"]
        parsed = validate.parse_questions(self.spark.createDataFrame(lines, "line long, raw string"))
        return validate.violations(parsed, self.segments).select(F.col("line").alias("request_no")).distinct()

    @staticmethod
    def _accepted(request: dict, reviewer: str, at: str, event_id: str) -> dict:
        return request.get("edited", {}) | {"verification_status": "verified", "annotation_source": "human_review", "reviewer_id": reviewer, "reviewed_at": at, "review_event_id": event_id}

    def decide(self, requests: list[dict], reviewer: str) -> tuple[list[dict], dict[int, str]]:
        """Appends what can be; (the events, refusals by place). A request, a person's act, is a dict with question_id, action,
        base_event_id, reason, edited (the question as edited) and playback (whether the video was played)."""
        at = datetime.now(timezone.utc).isoformat(timespec="seconds")
        requests = [r | {"request_no": n} for n, r in enumerate(requests)]
        rows = [(r["question_id"], r["action"], r.get("base_event_id"), r.get("reason"), bool(r.get("playback")), r["request_no"], r.get("edited", {}).get("question_id", r["question_id"]), r.get("edited", {}).get("video_id")) for r in requests]
        asked = self.spark.createDataFrame(rows, REQUEST)
        invalid = self._invalid(requests, reviewer, at)
        raw = {r["question_id"]: r["raw"] for r in self.candidates.join(asked.select("question_id").distinct(), "question_id").select("question_id", "raw").collect()}
        while True:
            last = self.events().agg(F.max("sequence")).first()[0] or 0
            fresh, refused = review.append_decisions(asked, self.latest(), last, self.candidates, invalid)
            events = []
            for e in fresh.orderBy("sequence").collect():
                own = uuid.uuid4().hex
                after = json.dumps(self._accepted(requests[e["request_no"]], reviewer, at, own), ensure_ascii=False) if e["action"] == "accept" else None
                events.append({"event_id": own, "sequence": e["sequence"], "previous_event_id": e["previous_event_id"], "question_id": e["question_id"], "action": e["action"], "reason": e["reason"], "reviewer_id": reviewer, "reviewed_at": at, "candidate_file_sha256": self.sha256, "candidate_before": raw[e["question_id"]], "annotation_after": after})
            refusals = {r["request_no"]: r["refusal"] for r in refused.collect()}
            if not events or self._put(last + 1, "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events)):
                return events, refusals

    def violations(self) -> DataFrame:
        """What review.log_violations() finds in the files."""
        return review.log_violations(self.events().withColumn("line_no", F.col("sequence")), self.candidates.select("question_id"), self.sha256)

    def export(self) -> DataFrame:
        """(question_id, raw): accepted rows as they were accepted."""
        head = self.latest().where("action = 'accept'").select("event_id")
        return self.events().join(head, "event_id", "left_semi").select("question_id", F.col("annotation_after").alias("raw"))
