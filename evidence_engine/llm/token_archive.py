"""Token archives: concatenated ids with Elias-Fano encoded document boundaries.

A sink and a source of Spark's Python data source interface, format "token_archive". Documents are dealt by ranges of
(id, hash of the text, place) and sorted within them, so the files of an archive, in the order of the partitions, are in
ascending order of ids. A task streams ids to a file and closes it at FILE_TOKENS ids or FILE_DOCS documents, whichever
comes first, so a task holds the boundaries of one file at most, however many or long the documents of its range are.

A file: the ids, 2 or 4 bytes each as the vocabulary needs; the boundaries of the documents, Elias-Fano; the document ids
(differences to the least), Elias-Fano too, as they ascend; a fixed footer. Elias-Fano keeps the low bits of a value
packed and the high bits in unary, some 2 + log2(mean length) bits a boundary. The n-th boundary is found by select: a
directory has the number of ones before each 512 bits in 4 bytes (a sixteenth of the high bits), the rest is
counted in one such block. Nothing has 8 bytes a document.

Each attempt of a task writes files of its own names; the driver commits by writing the manifest, a row for each file, by
a temporary name that is renamed. Files of lost attempts are in no manifest and never read; a commit removes those that
it knows of. A path that has a manifest is not written again.

Files are reached by Arrow's file systems (local, HDFS, S3, GCS).

Edge cases: a null or empty text has the end id alone; null ids come last, after the largest; equal ids stand side by
side, by the hash of their texts; repeated rows are each kept; ids may be negative; an empty table gives a manifest
without files and an empty result; other columns are passed by.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from evidence_engine.llm.bin_completion import word_table
from evidence_engine.llm.shared import text_slices

#: A file is closed when it has so many ids or documents.
FILE_TOKENS, FILE_DOCS = 1 << 26, 1 << 20
#: Ids that are read at once.
READ_TOKENS = 1 << 20
MANIFEST = "_manifest.json"
MAGIC = b"EFTOKEN1"
#: Width of an id; documents and those of them with a null id; ids; the least document id; then for both sequences the
#: number of values, the low bits of each, and the bytes of low bits, high bits and directory.
FOOTER = struct.Struct("<IQQQq" + "QIQQQ" * 2 + "8s")
BLOCK = 512


class EliasFano:
    """An ascending sequence of 64-bit numbers, as low bits, high bits in unary and a directory of ones."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.directory = n, width, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(width, dtype=np.uint64)
        step = 1 << 16  # a multiple of 8, so packed pieces join without a gap
        low = [np.packbits((values[i : i + step, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, step)] if width else []
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-int(ones[-1] + 1) // BLOCK) * BLOCK, np.uint8)
        bits[ones] = 1
        each = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, width, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(bits, bitorder="little"), (np.cumsum(each) - each).astype("<u4"))

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.directory.tobytes()

    def slice(self, a: int, b: int) -> np.ndarray:
        """The values a to b - 1, as int64 modulo 2**64: only the blocks that hold them are looked at."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = (int(np.searchsorted(self.directory, i, side="right")) - 1 for i in (a, b - 1))
        bits = np.unpackbits(self.high[first * BLOCK // 8 : (last + 1) * BLOCK // 8], bitorder="little")
        skip = a - int(self.directory[first])
        ones = np.flatnonzero(bits)[skip : skip + b - a] + first * BLOCK
        values = ones - np.arange(a, b) << self.width
        if self.width:
            begin = a * self.width
            low = np.unpackbits(self.low[begin // 8 : -(-b * self.width // 8)], bitorder="little")[begin % 8 :][: (b - a) * self.width]
            values |= low.reshape(-1, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return values

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0]) & 0xFFFFFFFFFFFFFFFF

    def rank(self, value: int) -> int:
        """How many values are smaller; a binary search over select."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self[mid] < value else (low, mid)
        return low


@dataclass
class Part(WriterCommitMessage):
    """A file of an archive."""

    name: str
    documents: int
    tokens: int
    first_id: int | None
    last_id: int | None


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list[Part]


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


class _File:
    """A file that is being written: ids go out as they come, lengths and document ids are held."""

    def __init__(self, fs: arrow_fs.FileSystem, folder: str, name: str, width: int) -> None:
        self.name, self.width, self.tokens = name, width, 0
        self.out = fs.open_output_stream(f"{folder}/{name}")
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.nulls = self.documents = 0

    def add(self, ids: pa.Array, tokens: list[bytes]) -> None:
        whole = np.frombuffer(b"".join(tokens), "<u4")
        if self.width == 2:
            if len(whole) and whole.max() > 0xFFFF:
                raise ValueError(f"id {whole.max()} is beyond the archive's max_id")
            whole = whole.astype("<u2")
        self.out.write(whole.tobytes())
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        self.lengths.append(sizes)
        self.tokens += int(sizes.sum())
        self.documents += len(tokens)
        self.nulls += ids.null_count
        self.ids.append(np.asarray(ids.drop_null(), np.int64))

    def close(self) -> Part:
        ends = np.cumsum(np.concatenate([[0], *self.lengths]))
        ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        least = int(ids[0]) if len(ids) else 0
        if (ids[1:] < ids[:-1]).any():
            raise ValueError("documents don't come in ascending order")
        sequences = EliasFano.of(ends), EliasFano.of((ids - least).astype(np.uint64))  # modulo 2**64, there and back
        sizes = []
        for s in sequences:
            parts = s.parts()
            for p in parts:
                self.out.write(p)
            sizes += [s.n, s.width, *map(len, parts)]
        self.out.write(FOOTER.pack(self.width, self.documents, self.nulls, self.tokens, least, *sizes, MAGIC))
        self.out.close()
        return Part(self.name, self.documents, self.tokens, least if len(ids) else None, int(ids[-1]) if len(ids) else None)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.width = 2 if int(options.get("max_id", 1 << 32)) <= 0xFFFF else 4
        self.file_tokens, self.file_docs = int(options.get("file_tokens", FILE_TOKENS)), int(options.get("file_docs", FILE_DOCS))
        fs, folder = file_system(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != arrow_fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds an archive")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        partition, fs_folder, attempt = TaskContext.get().partitionId(), file_system(self.path), uuid.uuid4().hex
        fs_folder[0].create_dir(fs_folder[1])
        parts: list[Part] = []
        now = None
        for batch in (b.slice(i, 1024) for b in iterator for i in range(0, b.num_rows, 1024)):
            ids, tokens = batch.column("doc_id"), batch.column("ids").to_pylist()
            at = 0
            while at < len(tokens):
                if now is None:
                    now = _File(*fs_folder, f"{partition:06}-{len(parts):04}-{attempt}.tokens", self.width)
                room, until = 4 * (self.file_tokens - now.tokens), at
                while until < len(tokens) and room > 0 and until - at < self.file_docs - now.documents:
                    room -= len(tokens[until])
                    until += 1
                now.add(ids.slice(at, until - at), tokens[at:until])
                at = until
                if now.tokens >= self.file_tokens or now.documents >= self.file_docs:
                    parts.append(now.close())
                    now = None
        if now is not None:
            parts.append(now.close())
        return Written(partition, parts)

    def commit(self, messages: list[Written | None]) -> None:
        parts = [p for m in sorted((m for m in messages if m), key=lambda m: m.partition) for p in m.parts]
        seen = [p for p in parts if p.first_id is not None]
        if any(a.last_id > b.first_id for a, b in zip(seen, seen[1:])):
            raise ValueError("partitions don't come in ascending order of ids")
        fs, folder = file_system(self.path)
        fs.create_dir(folder)
        own = f"{folder}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(json.dumps({"format": MAGIC.decode(), "files": [asdict(p) for p in parts]}).encode())
        fs.move(own, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        for p in (p for m in messages if m for p in m.parts):
            fs.delete_file(f"{folder}/{p.name}")


class TokenFile:
    """Reads a file by ranges: the footer and the sequences when opened, ids as asked for."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.width, self.documents, self.nulls, self.tokens, self.least, *sizes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        at, found = self.width * self.tokens, []
        for n, width, *lengths in (sizes[:5], sizes[5:]):
            parts = []
            for length, kind in zip(lengths, (np.uint8, np.uint8, "<u4"), strict=True):
                parts.append(np.frombuffer(self.file.read_at(length, at), kind))
                at += length
            found.append(EliasFano(n, width, *parts))
        self.bounds, self.ids = found

    def document_ids(self, a: int, b: int) -> pa.Array:
        known = self.documents - self.nulls
        ids = self.ids.slice(min(a, known), min(b, known)) + self.least
        return pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(b - a - len(ids), pa.int64())])

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from one place to another, as 4 bytes each."""
        raw = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4", copy=False)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of this id."""
        first, last = self.ids.rank(doc_id - self.least), self.ids.rank(doc_id - self.least + 1)
        return [self.read(*map(int, self.bounds.slice(i, i + 2))) for i in range(first, last)]

    def blocks(self, most: int = READ_TOKENS, docs: int = 1 << 14) -> Iterator[tuple[int, np.ndarray]]:
        """The number of the first document and the bounds of those after it, of at most `most` ids or one document."""
        a = 0
        while a < self.documents:
            bounds = self.bounds.slice(a, min(a + docs, self.documents) + 1)
            n = max(1, int(np.searchsorted(bounds, bounds[0] + most, side="right")) - 1)
            yield a, bounds[: n + 1]
            a += n


@dataclass
class _Split(InputPartition):
    name: str
    before: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], with_ids: bool) -> None:
        self.path, self.with_ids = options["path"], with_ids

    def partitions(self) -> list[_Split]:
        files = manifest(self.path)
        before = np.cumsum([0, *(f["tokens"] for f in files)])
        return [_Split(f["name"], int(b)) for f, b in zip(files, before)] or [_Split("", 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = file_system(self.path)
        file = TokenFile(fs, f"{folder}/{partition.name}")
        for a, bounds in file.blocks():
            ids = file.read(int(bounds[0]), int(bounds[-1]))
            raw, cuts = memoryview(ids).cast("B"), (4 * (bounds - bounds[0])).tolist()
            cols = [
                file.document_ids(a, a + len(bounds) - 1), pa.array(bounds[:-1] + partition.before), pa.array(np.diff(bounds)),
                pa.array([zlib.crc32(raw[i:j]) for i, j in zip(cuts, cuts[1:])], pa.int64()),
            ]
            if self.with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * self.with_ids])


class TokenArchive(DataSource):
    """Options: path; max_id, file_tokens and file_docs of the sink; with_ids of the source (true adds the ids themselves)."""

    @classmethod
    def name(cls) -> str:
        return "token_archive"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * self._with_ids()

    def _with_ids(self) -> bool:
        return self.options.get("with_ids", "false").lower() == "true"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self._with_ids())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def manifest(path: str) -> list[dict]:
    """A row for each file, in order."""
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def find(path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document of this id: only the files whose range holds it are opened, and only its ids read."""
    fs, folder = file_system(path)
    held = [f["name"] for f in manifest(path) if f["first_id"] is not None and f["first_id"] <= doc_id <= f["last_id"]]
    return [ids for name in held for ids in TokenFile(fs, f"{folder}/{name}").find(doc_id)]


def _tokens(tokenizer: str, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]):
        table = word_table(tokenizer)
        for batch in text_slices(batches, max_bytes=2 << 20):
            ids = [own + end for own in table.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def write_archive(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", **options: int) -> None:
    """Every document's ids and the end id, in ascending order of id_col."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    spark.dataSource.register(TokenArchive)
    most = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id or 0)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = (F.col("id").asc_nulls_last(), F.col("same"), F.col("place"))
    dealt = slim.withColumns({"same": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = dealt.select("id", "text").mapInArrow(_tokens(tokenizer, end_id), "doc_id long, ids binary")
    tokens.write.format("token_archive").options(max_id=most, **options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    spark.dataSource.register(TokenArchive)
    return spark.read.format("token_archive").option("with_ids", str(with_ids).lower()).load(path)
