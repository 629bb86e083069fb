"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(cell | class, history) * P(token | cell). There are 32 classes of 32 cells.
The most frequent tokens are a cell each, the end of a text among them; the others share cells by their first two
bytes and whether they end in a mark, so every token has a cell, known or not. Both softmaxes have hashed features of the
history: the last token, the last two (n-gram) and the one before the last (a skip); those of the cells are told
apart by class. Within a shared cell a token's weight has a closed form, the log of its smoothed count; one unseen
token is left room for.

Counts are gathered from all training texts. The weights of the first kind of feature start from one distributed pass of
counts; every round then takes one kind of feature and adds a distributed gradient step: observed and expected counts of
every feature and class (and cell) over all training texts, by numpy on the sparse rows that occur. Since just one feature
of a kind is active at a time, the step log(observed / expected), smoothed, is the one of iterative scaling and
can't overshoot. A round moves one block of numbers for each task and range of features, not texts.

Scoring reads each whole text once. Tokens of a bounded head of the vocabulary (`head` entries) are looked up in
place; the rest, which is most of the vocabulary and little of the text, is joined to the table of all counts,
so no count is approximated.

Edge cases: a null or empty text holds the end token alone; without training texts N and V are 0 and every
token is unknown; repeated rows are learned from and scored each; null ids are held out (no remainder to show
otherwise); extra columns are passed by. Texts to be scored must come from a table in a fixed order (a scan), as a row
is known by its place until its parts meet again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm.shared import materialize, text_slices

#: Written for the end of a text; it can't be a token, as tokens have no spaces.
END = " end"
MARKS = b".,;:!?"
CLASSES = 32
CELLS = CLASSES * CLASSES
#: Tokens with a cell of their own, at most.
SINGLES = 640
KINDS = ("last", "ngram", "skip")
#: Rows of features of each kind, for classes and for cells (of these each class has a share). The first kind is the one that
#: tells most, and its pass moves the fewest numbers.
BUCKETS = {"last": (1 << 16, 1 << 16), "ngram": (1 << 14, 1 << 14), "skip": (1 << 14, 1 << 14)}
#: A task of a pass sends tables of one size, so it should read at least so many tokens (some 32 MB of text).
TASK_TOKENS = 5_000_000
#: Numbers of pseudo-counts that a step may smooth with.
SMOOTH = tuple(4.0**k for k in range(12))
#: The order in which rounds take the kinds.
TURNS = (1, 2, 0)
SLOTS = 14


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), without the end."""
    return text.encode().lower().split() if text else []


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()
    ends = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in found), END], pa.string()), pa.array([*found.values(), ends], pa.int64())], names=["token", "n"])

    for batch in text_slices(batches):
        for text in batch.column("text").to_pylist():
            found.update(tokens(text))
            ends += 1
        if len(found) > 400_000:
            yield out()
            found.clear()
            ends = 0
    if ends or found:
        yield out()


# Hashes of all tokens of many texts at once: a polynomial over their bytes, by prefix sums modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_END_HASH = np.uint64(0x7F4A7C159E3779B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(1 << 20, 1 << n.bit_length())
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


@dataclass
class Cut:
    """The tokens of some texts, ends included: text, hash, first two bytes, whether the last is a mark."""

    doc: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray
    mark: np.ndarray
    is_end: np.ndarray


def cut(texts: list[bytes]) -> Cut:
    raw = b" " + b" ".join(texts) + b" "
    x = np.frombuffer(raw, np.uint8)
    space = _SPACE[x]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _power_tables(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=sums[1:])
    h = _mix((sums[end] - sums[start]) * inverse[start])
    second = np.where(end - start > 1, x[np.minimum(start + 1, len(x) - 1)], 0).astype(np.int32)
    prefix = x[start] + (second << 8)
    mark = np.isin(x[end - 1], np.frombuffer(MARKS, np.uint8))
    # Each text's words begin behind its bound; the end token goes behind the last of them.
    bound = np.cumsum([1, *(len(t) + 1 for t in texts)])
    n = np.diff(np.searchsorted(start, bound)) + 1
    doc = np.repeat(np.arange(len(texts)), n)
    is_end = np.zeros(len(doc), bool)
    is_end[np.cumsum(n) - 1] = True
    words = ~is_end
    out = Cut(doc, np.full(len(doc), _END_HASH), np.zeros(len(doc), np.int32), np.zeros(len(doc), bool), is_end)
    out.hash[words], out.prefix[words], out.mark[words] = h, prefix, mark
    return out


@dataclass
class Cells:
    """Which cell a token has, and the counts of each."""

    slot_hash: np.ndarray
    slot_cell: np.ndarray
    group_cell: np.ndarray  # by first two bytes and mark
    n: np.ndarray
    size: np.ndarray  # distinct tokens; 0 for tokens with a cell of their own

    def of(self, found: Cut) -> np.ndarray:
        slot = (found.hash >> np.uint64(64 - SLOTS)).astype(np.int64)
        cell = self.group_cell[found.prefix + found.mark * 65536]
        return np.where(self.slot_hash[slot] == found.hash, self.slot_cell[slot], cell).astype(np.int64)


def _dealt(weight: np.ndarray) -> np.ndarray:
    """Places for entries in order of weight, dealt to the classes back and forth, so that classes weigh alike."""
    order = np.argsort(-weight, kind="stable")
    turn, at = np.divmod(np.arange(len(weight)), CLASSES)
    column = np.where(turn % 2, CLASSES - 1 - at, at)
    out = np.empty(len(weight), np.int64)
    out[order] = column * CLASSES + turn
    return out


def make_cells(head: dict[str, int], groups: list[tuple[int, int, int]], ends: int) -> Cells:
    """From the counts of frequent tokens, and (code, n, distinct) of all tokens by first two bytes and mark."""
    names = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[:SINGLES]
    found = cut([w.encode() for w in names])
    words = ~found.is_end
    slot = (found.hash[words] >> np.uint64(64 - SLOTS)).astype(np.int64)
    _, first = np.unique(slot, return_index=True)  # of tokens with one slot the most frequent has a cell
    first = np.sort(first)
    codes = (found.prefix + found.mark * 65536)[words][first]
    own = np.array([head[names[i]] for i in first], np.int64)
    all_n, all_v = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)
    for code, n, v in groups:
        all_n[code], all_v[code] = n, v
    np.subtract.at(all_n, codes, own)
    np.subtract.at(all_v, codes, 1)
    room = CELLS - 2 - len(own)
    top = np.argsort(-all_n, kind="stable")[:room]
    top = top[all_n[top] > 0]
    n = np.concatenate([[ends], own, all_n[top], [all_n.sum() - all_n[top].sum()], np.zeros(CELLS - 2 - len(own) - len(top), np.int64)])
    size = np.concatenate([np.zeros(1 + len(own), np.int64), all_v[top], [all_v.sum() - all_v[top].sum()], np.zeros(CELLS - 2 - len(own) - len(top), np.int64)])
    place = _dealt(n)
    cells = Cells(np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64), np.full(1 << 17, place[1 + len(own) + len(top)], np.int64), np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64))
    cells.slot_hash[slot[first]], cells.slot_cell[slot[first]] = found.hash[words][first], place[1 : 1 + len(own)]
    at = int(_END_HASH >> np.uint64(64 - SLOTS))
    cells.slot_hash[at], cells.slot_cell[at] = _END_HASH, place[0]
    cells.group_cell[top] = place[1 + len(own) : 1 + len(own) + len(top)]
    cells.n[place], cells.size[place] = n, size
    return cells


def features(found: Cut, cell: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind the rows of all tokens: for classes, and for cells."""

    def back(k: int) -> np.ndarray:
        """The hash of the k-th token before, or what stands for the beginning."""
        out = np.full(len(found.hash), np.uint64(k))
        if len(out) > k:
            same = found.doc[k:] == found.doc[:-k]
            out[k:][same] = found.hash[:-k][same]
        return out

    h1, h2 = back(1), back(2)
    mixed = [_mix(h1 + np.uint64(1)), _mix(h1 * np.uint64(0x2545F4914F6CDD1D) ^ h2), _mix(h2 + np.uint64(3))]
    for_class, for_cell = [], []
    for kind, m in zip(KINDS, mixed, strict=True):
        rows, cell_rows = BUCKETS[kind]
        share = cell_rows // CLASSES
        for_class.append((m >> np.uint64(65 - rows.bit_length())).astype(np.uint16))
        for_cell.append(((cell >> 5) * share + (_mix(m) >> np.uint64(65 - share.bit_length())).astype(np.int64)).astype(np.uint16))
    return for_class, for_cell


@dataclass
class Weights:
    """Exponentials of the weights: of the classes and (by kind, None before its first round) of their features, and the
    same for cells."""

    prior: np.ndarray
    of_class: list[np.ndarray | None]
    cell_prior: np.ndarray  # class x cell
    of_cell: list[np.ndarray | None]

    def classes(self, rows: list[np.ndarray]) -> np.ndarray:
        return _product(self.prior, self.of_class, rows)

    def cells(self, rows: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """own: the classes whose cells are meant."""
        return _product(self.cell_prior[own], self.of_cell, rows)


def _product(prior: np.ndarray, tables: list[np.ndarray | None], rows: list[np.ndarray]) -> np.ndarray:
    p = np.array(np.broadcast_to(prior, (len(rows[0]), prior.shape[-1])))
    held = np.empty_like(p)
    for table, r in zip(tables, rows, strict=True):
        if table is not None:
            table.take(r, axis=0, out=held, mode="clip")
            p *= held
    p /= p @ np.ones((p.shape[1], 1), np.float32)
    return p


CHUNK = 1 << 13
BLOCK = 256


def _blocks(table: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for b in range(0, len(table), BLOCK):
        part = table[b : b + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict({"kind": [kind], "block": pa.array([b], pa.int32()), "value": [part.astype(np.float32).tobytes()]})


def _add_sums(table: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """Adds rows of p, which are in the order of `rows`, to the table."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    table[rows[first]] += np.add.reduceat(p, first, axis=0)


def _gradient(cells: Cells, kind: int, weights: Weights | None):
    """Counts for features of one kind: as observed and, with weights, as the model expects."""

    def run(batches: Iterable[pa.RecordBatch]):
        size = [n * CLASSES for n in BUCKETS[KINDS[kind]]]
        observed = [np.zeros(s, np.int64) for s in size]
        expected = [np.zeros((s // CLASSES, CLASSES)) for s in size]
        seen = False
        for batch in text_slices(batches, max_bytes=1 << 20):
            seen = True
            found = cut([t.encode().lower() if t else b"" for t in batch.column("text").to_pylist()])
            cell = cells.of(found)
            rows = features(found, cell)
            for level, what in enumerate((cell >> 5, cell & 31)):
                observed[level] += np.bincount(rows[level][kind].astype(np.int64) * CLASSES + what, minlength=size[level])
            if weights is None:
                continue
            for level in range(2):
                order = np.argsort(rows[level][kind], kind="stable")
                for at in range(0, len(order), CHUNK):
                    part = order[at : at + CHUNK]
                    own = [r[part] for r in rows[level]]
                    p = weights.cells(own, cell[part] >> 5) if level else weights.classes(own)
                    _add_sums(expected[level], own[kind], p)
        if seen:
            for level in range(2):
                yield from _blocks(observed[level].reshape(-1, CLASSES), f"observed{level}")
                if weights is not None:
                    yield from _blocks(expected[level], f"expected{level}")

    return run


def _sum_blocks(key, table):  # no annotations: Spark would read them
    parts = table.column("value")
    total = np.zeros(len(parts[0].as_py()) // 4, np.float64)
    for v in parts:
        total += np.frombuffer(v.as_py(), np.float32)
    return pa.table({"kind": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "value": [total.tobytes()]})


def gathered(train: DataFrame, cells: Cells, kind: int, weights: Weights | None) -> dict[str, np.ndarray]:
    """The summed tables of _gradient(): of one size, whatever the input."""
    out = {f"{name}{level}": np.zeros((rows, CLASSES)) for level, rows in enumerate(BUCKETS[KINDS[kind]]) for name in ("observed", "expected")[: 1 + (weights is not None)]}
    found = train.select("text").mapInArrow(_gradient(cells, kind, weights), "kind string, block int, value binary")
    for r in found.groupBy("kind", "block").applyInArrow(_sum_blocks, "kind string, block int, value binary").toLocalIterator():
        out[r["kind"]][r["block"] : r["block"] + BLOCK] = np.frombuffer(r["value"], np.float64).reshape(-1, CLASSES)
    return out


def _step(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """What the weights of a table's features are multiplied by.

    Observed counts are pulled towards what is expected by so many pseudo-counts a feature as tell each token best from
    all others (leave one out), so features seen too seldom to say anything stay as they are."""
    size = expected.sum(axis=1, keepdims=True)
    share = (expected + 1e-9) / (size + CLASSES * 1e-9)
    at, k = np.nonzero(observed)
    seen, own, total = observed[at, k], share[at, k], size[at, 0]

    def gain(smooth: float) -> float:
        return float(seen @ np.log((np.maximum(seen - 1, 0) + smooth * own) / (np.maximum(total - 1, 0) + smooth) / own))

    smooth = max(SMOOTH, key=gain)
    if gain(smooth) <= 0:
        return np.ones_like(share, np.float32)
    return ((observed + smooth * share) / ((size + smooth) * share)).astype(np.float32)


def first_weights(cells: Cells, counts: dict[str, np.ndarray] | None) -> Weights:
    """The shares of classes and cells and, from observed counts, the features of the first kind."""
    n = (cells.n + 1e-3).reshape(CLASSES, CLASSES)
    prior, cell_prior = n.sum(axis=1) / n.sum(), n / n.sum(axis=1, keepdims=True)
    weights = Weights(prior.astype(np.float32), [None] * len(KINDS), cell_prior.astype(np.float32), [None] * len(KINDS))
    if counts:
        own = np.repeat(cell_prior, BUCKETS[KINDS[0]][1] // CLASSES, axis=0)
        for tables, observed, share in ((weights.of_class, counts["observed0"], prior), (weights.of_cell, counts["observed1"], own)):
            tables[0] = _step(observed, observed.sum(axis=1, keepdims=True) * share)
    return weights


def add_step(weights: Weights, kind: int, counts: dict[str, np.ndarray]) -> None:
    for level, tables in enumerate((weights.of_class, weights.of_cell)):
        step = _step(counts[f"observed{level}"], counts[f"expected{level}"])
        tables[kind] = step if tables[kind] is None else tables[kind] * step


@dataclass
class Model:
    counts: DataFrame
    n: int
    v: int
    cells: Cells
    weights: Weights
    head: dict[str, int]


def _head(counts: DataFrame, most: int) -> dict[str, int]:
    """Tokens whose counts reach a level that at most `most` reach; only these leave the executors."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    found, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("level")).collect():  # a row for each 16th of a power of 2
        found += r["tokens"]
        if found > most:
            break
        least = r["level"]
    return {} if least is None else {r["token"]: r["n"] for r in counts.where(level >= least).collect()}


def _groups(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(code, n, distinct) of the tokens by first two bytes and mark, at most 2**17 rows."""
    raw = F.col("token").cast("binary")
    byte = lambda x: F.coalesce(F.conv(F.hex(x), 16, 10).cast("int"), F.lit(0))
    last = F.substring("token", -1, 1).isin(*MARKS.decode())
    code = byte(F.substring(raw, 1, 1)) + byte(F.substring(raw, 2, 1)) * 256 + F.when(last, 65536).otherwise(0)
    return [tuple(r) for r in counts.where(F.col("token") != END).groupBy(code.alias("code")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()]


def train(docs: DataFrame, rounds: int = 2, head: int = 100_000) -> Model:
    """Learns from every text of docs(text)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = materialize(texts.mapInArrow(_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("token") == END, F.col("n"))).alias("ends")).first()
    common = _head(counts, head)
    cells = make_cells(common, _groups(counts), total["ends"] or 0)
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-(total["n"] or 0) // TASK_TOKENS)))
    weights = first_weights(cells, gathered(texts, cells, 0, None) if total["n"] else None)
    for r in range(rounds if total["n"] else 0):
        kind = TURNS[r % len(TURNS)]
        add_step(weights, kind, gathered(texts, cells, kind, weights))
    return Model(counts, total["n"] or 0, total["v"], cells, weights, common)


def log10_model(cells: Cells, weights: Weights, found: Cut) -> np.ndarray:
    """For each token log10 of P(cell | history), less the log10 of what its smoothed count is divided by."""
    # A cell of one token: its count cancels out.
    under = np.where(cells.size > 0, cells.n + 0.5 * (cells.size + 1), cells.n + 0.5)
    cell = cells.of(found)
    rows = features(found, cell)
    out = np.empty(len(cell))
    for at in range(0, len(cell), CHUNK):
        part = slice(at, at + CHUNK)
        own = [[r[part] for r in level] for level in rows]
        c, s = cell[part] >> 5, cell[part] & 31
        p = weights.classes(own[0])[np.arange(len(c)), c].astype(np.float64) * weights.cells(own[1], c)[np.arange(len(c)), s]
        out[part] = np.log10(p)
    return out - np.log10(under)[cell]


def _scorer(cells: Cells, weights: Weights, head: dict[str, int]):
    """A row for each text (its token is unique and no token) with all that is known in place, and one for each distinct
    other token of a text."""
    schema = pa.schema([("uid", pa.string()), ("token", pa.string()), ("times", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_model", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        log_count = {w.encode(): math.log10(n + 0.5) for w, n in head.items()}
        end, end_known = (log_count[END.encode()], 1) if END in head else (0.0, 0)
        part, seen = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, max_bytes=1 << 20):
            n = batch.num_rows
            raw = [t.encode().lower() if t else b"" for t in batch.column("text").to_pylist()]
            found = cut(raw)
            log_model = np.bincount(found.doc, log10_model(cells, weights, found), minlength=n)
            uid = [f" {part}:{seen + i}" for i in range(n)]
            seen += n
            known, logs, owner, token, times = [], [], [], [], []
            for i, text in enumerate(raw):
                words = text.split()
                logs.append(sum(map(log_count.get, words, repeat(0.0))) + end)
                rare = Counter([w for w in words if w not in log_count])
                known.append(len(words) - rare.total() + end_known)
                if not end_known:
                    rare[END.encode()] = 1
                owner.extend([uid[i]] * len(rare))
                token.extend(rare)
                times.extend(rare.values())
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(uid), pa.nulls(n, pa.int64()), batch.column("id"), batch.column("held_out"), pa.array(np.bincount(found.doc, minlength=n)), pa.array(known), pa.array(logs, pa.float64()), pa.array(log_model)], schema=schema)
            if owner:
                none = lambda kind: pa.nulls(len(owner), kind)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(token, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(id, held_out, text) -> id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    parts = docs.select(F.col("id").cast("long").alias("id"), "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        _scorer(model.cells, model.weights, model.head),
        "uid string, token string, times long, id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double",
    )
    joined = parts.join(model.counts.withColumnRenamed("n", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    times = F.coalesce("times", F.lit(0))
    sums = joined.groupBy("uid").agg(
        *(F.max(x).alias(x) for x in ("id", "held_out", "n_tokens", "log_model")),
        (F.max("n_known") + F.sum(F.when(c > 0, times).otherwise(0))).alias("n_known"),
        (F.max("log_counts") + F.sum(times * F.log10(c + 0.5))).alias("log_counts"),
    )
    base = math.log10(model.n + 0.5 * (model.v + 1))
    return sums.select("id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("log_counts") + F.col("log_model")).alias("score"))


def train_and_score(spark: SparkSession, docs: DataFrame, rounds: int = 2) -> DataFrame:
    """docs(id, held_out, text): learns from the rows that aren't held out, scores all."""
    return score(docs, train(docs.where("not held_out"), rounds))
