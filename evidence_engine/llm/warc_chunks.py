"""WARC archives through a chunked record table.

Writing: payloads are cut into rows of a chunk table (record, chunk number, at most CHUNK characters) by the task that reads
them, in one pass over each, before anything is shuffled, joined or sorted; only chunks travel. A record of one chunk is one archive record; of several, the first is a response and
each other a segment of it (the format's continuation records). A segment carries the digest of the payload so far, which
runs on from chunk to chunk; the last one must meet the digest that was planned with. Archives are gzip text files of
Spark's writer, whose line separator is the end of a record; they reach any store that Spark reaches. Each begins with a
warcinfo record; a file is one gzip member, so it is read from its beginning.

Planning: digests, not payloads, meet by digest (those of pages that recur very often by broadcast). What a record revisits
is then joined to its chunks by page and digest, which is the one shuffle of chunks; copies of one page under many ids
are spread by it. The chunks of a record that revisits another are dropped but for the first, which loses its text.

Reading: an archive is one unsplit stream of lines; a parser follows the content lengths and gives one row
for each record and chunk number, with the bytes and the digest so far; the row of the last chunk has those of
the whole payload. No payload is held whole.

Edge cases: a null payload is an empty one; equal payloads under the least size are all responses; of equal
larger ones the row of the largest id is the response (all rows of that id, if ids repeat; a null id counts
as the smallest); every record has an id of its own, by its place in the archives, whether or not page ids repeat; a
null url is written as about:blank, control characters and spaces in one as percent codes; extra columns are passed by;
an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.shared import lookup, materialize, text_slices

END = "\r\n\r\n"
#: Characters of a chunk, a megabyte at most.
CHUNK = 1 << 18
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class Plan:
    """pages(page_id, url, payload), and for those that revisit another revisits(own_id, own_digest, response)."""

    pages: DataFrame
    revisits: DataFrame


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> Plan:
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    slim = materialize(base.where(F.octet_length("payload") >= least_bytes).select("page_id", "url", F.sha1(F.col("payload").cast("binary")).alias("digest")), "digests")
    shared = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("response"))
    shared = materialize(shared.where("n > 1 and response.page_id is not null"), "shared-digests")
    again = lookup(slim.select("page_id", "digest"), shared, "digest", "n").where("not page_id <=> response.page_id")
    return Plan(base, again.groupBy(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest")).agg(F.max("response").alias("response")))


_CUT = [("page_id", pa.int64()), ("url", pa.string()), ("record", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("chunk_number", pa.int32()), ("chunks", pa.int32()), ("part", pa.string())]


def _cut(chunk_chars: int):
    schema = pa.schema(_CUT)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches, column="payload"):
            rows, held = [], 0
            for page_id, url, payload, record in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "record")), strict=True):
                page_id, url, record, text = page_id.as_py(), url.as_py(), record.as_py(), payload.as_py()
                starts = range(0, max(1, len(text)), chunk_chars)
                digest, size = hashlib.sha1(), 0
                for at in starts:
                    raw = text[at : at + chunk_chars].encode()
                    digest.update(raw)
                    size += len(raw)
                digest = digest.hexdigest()
                for number, at in enumerate(starts, 1):
                    rows.append((page_id, url, record, digest, size, number, len(starts), text[at : at + chunk_chars]))
                    held += len(rows[-1][-1])
                    if held > 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def chunk_rows(plan: Plan, chunk_chars: int = CHUNK) -> DataFrame:
    """A row for each chunk, those of a record side by side and in order: (page_id, url, digest, bytes, response_id, response_url,
    chunk_number, chunks, part). A record that revisits another has one chunk without a part."""
    cut = plan.pages.withColumn("record", F.monotonically_increasing_id()).mapInArrow(_cut(chunk_chars), "page_id long, url string, record long, digest string, bytes long, chunk_number int, chunks int, part string")
    met = cut.join(plan.revisits.hint("merge"), cut.page_id.eqNullSafe(F.col("own_id")) & (cut.digest == F.col("own_digest")), "left")
    again = F.col("response").isNotNull()
    kept = met.where(~again | (F.col("chunk_number") == 1)).sortWithinPartitions("page_id", "digest", "record", "chunk_number")
    return kept.select("page_id", "url", "digest", "bytes", F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"), "chunk_number", F.when(again, 1).otherwise(F.col("chunks")).alias("chunks"), F.when(~again, F.col("part")).alias("part"))


def _record(kind: str, rid: str, fields: list[tuple[str, object]], block: str) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *fields, ("Content-Length", len(block.encode()))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block


def _target(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


class _Writer:
    """Archive records from chunk rows, which come in order."""

    def __init__(self, date: str, place: str) -> None:
        self.date, self.place, self.n = date, place, 0

    def _id(self) -> str:
        self.n += 1
        return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{self.place}:{self.n}')}>"

    def info(self) -> str:
        return _record("warcinfo", self._id(), [("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], "format: WARC File Format 1.0\r\n")

    def row(self, page_id: int | None, url: str | None, digest: str, size: int, response_id: int | None, response_url: str | None, number: int, chunks: int, part: str | None) -> str:
        named = [("Page-Id", "" if page_id is None else page_id), ("WARC-Date", self.date), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n"
        if response_id is not None:
            return _record("revisit", self._id(), [*named, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _target(response_url)), ("WARC-Refers-To-Date", self.date), ("Refers-To-Page-Id", response_id)], http)
        if number == 1:
            self.digest, self.done, self.origin = hashlib.sha1(), 0, self._id()
        raw = part.encode()
        self.digest.update(raw)
        self.done += len(raw)
        if number == chunks and (self.done, self.digest.hexdigest()) != (size, digest):
            raise ValueError(f"the chunks of page {page_id} aren't its payload: {self.done} bytes for {size}")
        if chunks == 1:
            return _record("response", self.origin, named, http + part)
        own = [("WARC-Segment-Number", number), ("Running-Digest", f"sha1:{self.digest.hexdigest()}")]
        if number == 1:
            return _record("response", self.origin, [*named, *own], http + part)
        total = [("WARC-Segment-Total-Length", self.done + len(http))] if number == chunks else []
        return _record("continuation", self._id(), [("WARC-Date", self.date), ("WARC-Segment-Origin-ID", self.origin), *own, *total], part)


_CHUNK_COLUMNS = ("page_id", "url", "digest", "bytes", "response_id", "response_url", "chunk_number", "chunks", "part")


def _writer(date: str, run_id: str):
    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        writer = _Writer(date, f"{run_id}:{TaskContext.get().partitionId()}")
        for batch in batches:
            out: list[str] = [] if writer.n or not batch.num_rows else [writer.info()]
            held = 0
            cols = [batch.column(c) for c in _CHUNK_COLUMNS]
            for i in range(batch.num_rows):
                out.append(writer.row(*(c[i].as_py() for c in cols)))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": out})
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out})

    return run


def write_archives(records: Plan, path: str, date: str = "2024-01-01T00:00:00Z", chunk_chars: int = CHUNK) -> None:
    """Writes what plan_records() planned as archives under path."""
    lines = chunk_rows(records, chunk_chars).mapInArrow(_writer(date, uuid.uuid4().hex), "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


class _Parser:
    """Follows the lines of archives and gives the chunks that end."""

    def __init__(self, with_payload: bool) -> None:
        self.state, self.with_payload = "between", with_payload
        self.digest, self.total, self.chunk = hashlib.sha1(), 0, 0
        self.origin: dict[str, str] = {}
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> dict | None:
        """line: without its newline. The chunk row that it ends, if any."""
        if self.state == "between":
            if line.startswith(b"WARC/1."):
                self.state, self.head = "head", {}
            elif line.strip():
                raise ValueError(f"not the start of a record: {line[:60]!r}")
            return None
        if self.state == "head":
            if line == b"\r":
                return self._open()
            name, _, value = line.decode().rstrip("\r").partition(": ")
            self.head[name] = value
            return None
        data = (line + b"\n")[: self.left]
        self.left -= len(data)
        if self.state == "info":
            pass
        elif self.state == "http":
            if line == b"\r":
                self.state = "body"
            elif line.lower().startswith(b"content-length: "):
                self.http_length = int(line.split(b": ")[1])
        else:
            self._take(data)
        return self._close() if not self.left else None

    def _open(self) -> dict | None:
        self.left = int(self.head["Content-Length"])
        if self.head["WARC-Type"] == "warcinfo":
            self.state = "info"
            return None if self.left else self._close()
        self.state = "body" if self.head["WARC-Type"] == "continuation" else "http"
        if self.state == "http":
            self.digest, self.total, self.chunk, self.origin, self.http_length = hashlib.sha1(), 0, 0, self.head, 0
        elif self.head["WARC-Segment-Origin-ID"] != self.origin.get("WARC-Record-ID"):
            raise ValueError(f"segment without its record: {self.head}")
        return None if self.left else self._close()

    def _take(self, data: bytes) -> None:
        self.digest.update(data)
        self.total += len(data)
        if self.with_payload:
            self.parts.append(data)

    def _close(self) -> dict | None:
        known, self.state = self.state, "between"
        if known == "info":
            return None
        self.chunk += 1
        head, kind = self.origin, self.origin["WARC-Type"]
        said = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        last = kind == "revisit" or self.total == self.http_length
        so_far = said if kind == "revisit" else self.digest.hexdigest()
        expected = said if last else self.head["Running-Digest"].removeprefix("sha1:")
        if so_far != expected:
            raise ValueError(f"payload of {head['WARC-Record-ID']} has digest {so_far}, not {expected}")
        number = lambda x: int(x) if x else None
        row = {"record_id": head["WARC-Record-ID"], "chunk_number": self.chunk, "last": last, "page_id": number(head["Page-Id"]), "url": head["WARC-Target-URI"], "record_type": kind, "refers_to": number(head.get("Refers-To-Page-Id")), "bytes_so_far": self.http_length if kind == "revisit" else self.total, "digest_so_far": so_far}
        if self.with_payload:
            row["payload"] = b"".join(self.parts)
            self.parts = []
        return row


_FIELDS = [("record_id", pa.string()), ("chunk_number", pa.int32()), ("last", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]


def _reader(with_payload: bool):
    schema = pa.schema([*_FIELDS, *([("payload", pa.binary())] if with_payload else [])])

    def run(batches: Iterable[pa.RecordBatch]):
        parser = _Parser(with_payload)
        for batch in batches:
            rows, held = [], 0
            for line in batch.column("value").to_pylist():
                row = parser.feed(line)
                if row:
                    rows.append(row)
                    held += len(row.get("payload", b""))
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if parser.state != "between":
            raise ValueError("an archive ends within a record")

    return run


def read_chunks(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The chunk table of the archives under path: a row for each record and chunk number."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    kinds = "record_id string, chunk_number int, last boolean, page_id long, url string, record_type string, refers_to long, bytes_so_far long, digest_so_far string"
    return lines.mapInArrow(_reader(with_payload), kinds + ", payload binary" * with_payload)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record: its last chunk."""
    return read_chunks(spark, path).where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
