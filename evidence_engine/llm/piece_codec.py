"""SentencePiece encoding and decoding through a table of distinct chunks.

In these models no piece holds a white-space marker after another character, so no merge crosses from a
character to a following marker: a text falls into chunks of markers followed by other characters, and
each chunk has the same pieces wherever it stands. A task therefore keeps a table of the distinct chunks
that it has met, segments each once with the library, and joins ids and surfaces back by position. The
table is rebuilt from the task's own rows (nothing is lost with an executor) and is emptied when it reaches
its bound, which costs time but changes no result.

Edge cases: a null text is encoded as the empty text (no ids, empty decoding); white space of every length
and literal markers are kept as the library keeps them; repeated rows give repeated rows; extra columns are
passed by unless asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import text_slices

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
_tables: dict[str, ChunkTable] = {}


class ChunkTable:
    """Distinct chunk -> (ids as decimals joined by commas, surface). A key is the chunk less its first marker."""

    def __init__(self, model: str, max_entries: int = 400_000, max_key: int = 256) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.mark = self.sp.piece_to_id(MARK)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing or self.sp.encode(" a") == self.sp.encode("a"):
            raise ValueError(f"pieces of {model} may cross white space; chunks can't be segmented apart")
        self.max_entries, self.max_key = max_entries, max_key
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}

    def _add(self, keys: list[str], ids: dict[str, str], surface: dict[str, str]) -> None:
        for key, found in zip(keys, self.sp.encode([k or "a" for k in keys], num_threads=1), strict=True):
            found = found if key else [self.mark]
            ids[key] = ",".join(map(str, found))
            surface[key] = self.sp.decode([self.mark, *found])

    def encode(self, text: str) -> tuple[str, str]:
        """The text's ids joined by commas, and its decoding."""
        if not text:
            return "", ""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            keys = [c[1:] for c in _CHUNK.findall(" " + text)]
        else:
            keys = text.split(" ")
        new = set(keys).difference(self.ids)
        ids, surface = self.ids, self.surface
        if new:
            if len(self.ids) + len(new) > self.max_entries:
                self.ids.clear()
                self.surface.clear()
                new = set(keys)
            small = [k for k in new if len(k) <= self.max_key]
            self._add(small, ids, surface)
            if len(small) < len(new):
                ids, surface = {k: ids[k] for k in small} | {k: ids[k] for k in set(keys) - new}, {k: surface[k] for k in small} | {k: surface[k] for k in set(keys) - new}
                self._add([k for k in new if len(k) > self.max_key], ids, surface)
        return ",".join(map(ids.__getitem__, keys)), "".join(map(surface.__getitem__, keys))[1:]


def chunk_table(model: str) -> ChunkTable:
    """One for each worker process and model."""
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def _encoder(model: str, keep: list[str], digest: bool):
    def run(batches: Iterable[pa.RecordBatch]):
        table = chunk_table(model)
        for batch in text_slices(batches):
            out: dict[str, list] = {"n_tokens": [], "ids": [], "decoded": []}
            for text in batch.column("text").to_pylist():
                ids, decoded = table.encode(text or "")
                out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                if digest:
                    out["ids"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded"].append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    out["ids"].append([int(x) for x in ids.split(",")] if ids else [])
                    out["decoded"].append(decoded)
            head = [batch.column(f"_k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*head, pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids"], pa.string() if digest else pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())], names=[*(f"_k{i}" for i in range(len(keep))), "n_tokens", "ids", "decoded"])

    return run


def encode(df: DataFrame, model: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The kept columns, n_tokens, ids (array<int>) and decoded; with digest, lowercase hex SHA-256 of both instead."""
    keep = list(keep)
    slim = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"_k{i} {slim.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    got = slim.mapInArrow(_encoder(model, keep, digest), f"{kinds}{', ' * bool(kinds)}n_tokens long, ids {'string' if digest else 'array<int>'}, decoded string")
    named = {"ids": "ids_sha256", "decoded": "decoded_sha256"} if digest else {}
    return got.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", *(F.col(c).alias(named.get(c, c)) for c in ("ids", "decoded")))
