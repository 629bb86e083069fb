"""Exact top-k inner-product search over a bit-sliced index.

Each vector component is an integer attribute. A block of rows stores, per dimension, the bits of
(value - least value of the block) as bitmaps over the rows. A query's score is a weighted sum of the
attributes, so it is added up on bitmaps: every set bit of a weight selects the slices to be added at the
matching significance (complements for negative weights), and carry-save adders reduce the bitmaps of one
significance to one, passing carries on. The top rows are then taken from the most significant score
slice downward; rows that tie at the boundary are resolved by their scores and ids.

Rows and queries are both cut into blocks of bounded size, and one row of the join holds one pair of
blocks, so memory doesn't grow with the table; each pair keeps k rows a query.

Edge cases: null ids, null vectors and vectors with null or non-finite components take no part; all others do, however
large: blocks whose numbers might leave 64 bits are added up in whole numbers without a bound, and a score among the
best that doesn't fit a long is an error, not a wrong row. A shorter vector counts as padded with zeros. Repeated rows are candidates each; of rows that repeat a query's id the
least valid vector asks, and none of them is its own candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantised components up to this are 64-bit numbers; larger ones are Python's.
NARROW = 2.0**62


def vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the quantised matrix of the valid rows."""
    ids, lists = batch.column(0), batch.column(1)
    keep = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    rows = np.flatnonzero(keep)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    picked = lists.take(pa.array(rows))
    flat = np.asarray(picked.flatten().cast(pa.float64()).fill_null(math.nan), dtype=np.float64)
    length = np.asarray(pc.list_value_length(picked), dtype=np.int64)
    width = int(length.max(initial=0))
    out = np.zeros((len(rows), width))
    out[np.arange(width)[None, :] < length[:, None]] = flat
    good = np.isfinite(out).all(axis=1)
    out, kept = out[good], np.asarray(ids.take(pa.array(rows)), dtype=np.int64)[good]
    if np.all(np.abs(out) < NARROW / scale):
        return kept, np.floor(out * scale).astype(np.int64)
    # From 2**53 on a double is a whole number.
    whole = [[math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in row] for row in out.tolist()]
    return kept, np.array(whole, dtype=object).reshape(out.shape)


def _pack(x: np.ndarray) -> bytes:
    return b",".join(str(v).encode() for v in x.ravel()) if x.dtype == object else b"=" + x.astype(np.int64).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64, offset=1) if raw[:1] == b"=" else np.array([int(v) for v in raw.split(b",")], dtype=object)


def _bit_length(x: np.ndarray) -> int:
    return max((int(v).bit_length() for v in (x.max(initial=0), x.min(initial=0))), default=0)


def _gathered(batches: Iterator[pa.RecordBatch], scale: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most so many rows."""
    ids: list[np.ndarray] = []
    mats: list[np.ndarray] = []
    held = 0

    def block():
        width = max(m.shape[1] for m in mats)
        return np.concatenate(ids), np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in mats])

    for batch in batches:
        i, m = vectors(batch, scale)
        for at in range(0, len(i), rows):
            part = slice(at, at + rows)
            if held + len(i[part]) > rows:
                yield block()
                ids, mats, held = [], [], 0
            ids.append(i[part])
            mats.append(m[part])
            held += len(i[part])
    if held:
        yield block()


class BitSlicedBlock:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        self.words = max(1, -(-self.n // 64))
        if mat.dtype != object and _bit_length(mat) > 61:
            mat = mat.astype(object)
        self.offset = mat.min(axis=0) if mat.shape[1] else np.zeros(0, np.int64)
        u = mat - self.offset
        self.bits = np.array([int(x).bit_length() for x in u.max(axis=0)], dtype=np.int64) if mat.shape[1] else np.zeros(0, np.int64)
        self.dim = np.repeat(np.arange(len(self.bits)), self.bits)
        self.power = np.concatenate([np.arange(b) for b in self.bits]) if self.bits.sum() else np.zeros(0, np.int64)
        self.slices = np.zeros((len(self.dim), self.words), np.uint64)
        for r, (d, p) in enumerate(zip(self.dim, self.power, strict=True)):
            self.slices[r] = self._bitmap(u[:, d] >> int(p) & 1)

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def prepare(self) -> None:
        self.full = np.concatenate([self.slices, ~self.slices])
        self.valid = self._bitmap(np.ones(self.n, np.uint8))

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the score less a constant, least significant first, and the constant."""
        d = min(len(query), len(self.bits))
        offset, bits = self.offset, self.bits
        if _bit_length(query) + max(_bit_length(offset), int(bits.max(initial=0))) + len(bits).bit_length() > 62:
            query, offset, bits = query.astype(object), offset.astype(object), bits.astype(object)
        q = np.zeros(len(bits), query.dtype)
        q[:d] = query[:d]
        size = np.abs(q)
        const = int((q * offset).sum()) - int((size * ((1 << bits) - 1))[q < 0].sum())
        at = np.arange(len(self.dim)) + np.where(q < 0, len(self.dim), 0)[self.dim] if len(self.dim) else np.zeros(0, np.int64)
        at_size = size[self.dim]
        rows, power = [], []
        for k in range(int(size.max(initial=0)).bit_length()):
            on = (at_size >> k & 1).astype(bool)
            rows.append(at[on])
            power.append(self.power[on] + k)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        power = np.concatenate(power) if power else np.zeros(0, np.int64)
        order = np.argsort(power, kind="stable")
        rows, starts = rows[order], np.searchsorted(power[order], np.arange(int(power.max(initial=-1)) + 2))
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        p = 0
        while p + 1 < len(starts) or carried:
            own = self.full[rows[starts[p] : starts[p + 1]]] if p + 1 < len(starts) else self.full[:0]
            stack = np.concatenate([own, *carried]) if carried else own
            carried = []
            while len(stack) >= 3:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * m :]]) if len(stack) > 3 * m else x ^ c
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            p += 1
        return out, const

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and scores of the k best rows, ties to the smaller id, and whether the scores fit a long (else the nearest one)."""
        score, const = self.score_slices(query)
        sure = np.zeros(self.words, np.uint64)
        equal = self.valid
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            flags = np.zeros(self.n, np.uint8)
            flags[own] = 1
            equal = equal & ~self._bitmap(flags)
        for bitmap in reversed(score):
            take = sure | (equal & bitmap)
            n = int(np.bitwise_count(take).sum())
            if n > k:
                equal = equal & bitmap
            else:
                sure = take
                equal = equal & ~bitmap
                if n == k:
                    equal = np.zeros(self.words, np.uint64)
                    break
        got = self.rows(sure)
        ties = self.rows(equal)
        short = k - len(got)
        if short > 0 and len(ties):
            got = np.concatenate([got, ties[np.argsort(self.ids[ties], kind="stable")[:short]]])
        narrow = len(score) < 62 and abs(const) < 2**62
        value = np.full(len(got), const, np.int64 if narrow else object)
        for p, bitmap in enumerate(score):
            value += (bitmap[got >> 6] >> (got & 63).astype(np.uint64) & np.uint64(1)).astype(value.dtype) << p
        near = value if narrow else np.array([min(max(v, -(2**63)), 2**63 - 1) for v in value], np.int64)
        return self.ids[got], near, np.array(near == value, bool)


def _index_blocks(scale: int, rows: int):
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        for ids, mat in _gathered(batches, scale, rows):
            b = BitSlicedBlock(ids, mat)
            yield pa.RecordBatch.from_pydict({"i": pa.array([part], pa.int32()), "ids": [ids.tobytes()], "offsets": [_pack(b.offset)], "bits": [b.bits.tobytes()], "slices": [b.slices.tobytes()]})

    return run


def _query_blocks(scale: int, rows: int):
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        for ids, mat in _gathered(batches, scale, rows):
            yield pa.RecordBatch.from_pydict({"j": pa.array([part], pa.int32()), "query_ids": [ids.tobytes()], "weights": [_pack(mat)]})

    return run


def _search(k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind)
                block = BitSlicedBlock.__new__(BitSlicedBlock)
                block.ids = get("ids", np.int64)
                block.n = len(block.ids)
                block.words = max(1, -(-block.n // 64))
                block.offset, block.bits = _unpack(batch.column("offsets")[r].as_py()), get("bits", np.int64)
                block.dim = np.repeat(np.arange(len(block.bits)), block.bits)
                block.power = np.concatenate([np.arange(b) for b in block.bits]) if block.bits.sum() else np.zeros(0, np.int64)
                block.slices = get("slices", np.uint64).reshape(len(block.dim), block.words)
                block.prepare()
                queries = get("query_ids", np.int64)
                weights = _unpack(batch.column("weights")[r].as_py()).reshape(len(queries), -1)
                found = [block.top(int(q), w, k) for q, w in zip(queries, weights, strict=True)]
                n = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(queries, n), "vec_id": np.concatenate([x[0] for x in found]), "score": np.concatenate([x[1] for x in found]), "fits": np.concatenate([x[2] for x in found])})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the largest integer inner product.

    rows and queries have id_col and vector_col; other columns are ignored. block_rows and query_rows bound
    what one task holds at a time (a block of 8192 rows of 64 components takes under 1 MB)."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    valid = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))  # as in vectors(): NaN is larger
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(valid).groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_queries = base.count(), asked.count()
    n_i, n_j = max(1, math.ceil(n_rows / block_rows)), max(1, math.ceil(n_queries / query_rows))
    index = base.repartition(n_i).mapInArrow(_index_blocks(scale, block_rows), "i int, ids binary, offsets binary, bits binary, slices binary")
    query = asked.repartition(n_j).mapInArrow(_query_blocks(scale, query_rows), "j int, query_ids binary, weights binary")
    cells = min(n_i * n_j, 4096)
    left = index.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_j - 1)))).repartition(cells, "i", "j")
    right = query.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1)))).repartition(cells, "i", "j")
    best = left.join(right, ["i", "j"]).mapInArrow(_search(k), "query_id long, vec_id long, score long, fits boolean")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit a long"))).alias("score"))
