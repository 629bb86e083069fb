"""Packing documents into sequences by bin completion on the histogram of lengths.

Tokens come from a table of distinct words: the tokenizer drops white space and never merges across it, so
a word has the same ids wherever it stands. Pieces of one length are interchangeable, so the search needs
only the number of pieces of each length, at most `capacity` numbers however large the corpus is. It packs
by best fit in descending order first; if that isn't at the lower bound of bins, bin completion looks for
fewer: it takes the largest piece left, enumerates the fillings around it that no other one dominates, those of
least waste first (sums that can be reached are known from bit sets, so no dead end is entered), closes as many
bins at once as the counts allow, then one fewer and so on, and leaves branches that waste more than the incumbent
lets them. Best fit for what a node leaves may become the new incumbent. The search ends when the bound is met or
all is tried, which proves the packing, or after `max_work` looks at lengths (some seconds of the driver): then the
incumbent stands, which may be a few bins above the fewest (the problem is strongly NP-hard, and no bound of
work makes it otherwise).

The plan says how many pieces of a length go to which group of equal bins. A piece's place follows from its
rank among the pieces of its length, which is counted in hashed sub-groups of a length, so a length that a
third of all pieces have is not ranked in one task.

Edge cases: a null text is an empty one and gives the end id alone; repeated rows are packed each; null ids
are carried; a document of exactly the capacity is not cut; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.shared import materialize, text_slices

_tables: dict[str, WordTable] = {}
#: ASCII marks at the end of a word are one run for the tokenizer; not so the apostrophe, which begins contractions.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER, _MARK, _SPACE = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((_LETTER, bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))), (_MARK, _TAIL), (_SPACE, b" \t\n\v\f\r")):
    _KIND[list(_bytes)] = _kind
#: Words of ASCII letters and those of U+00C0 to U+00FF: letters for the tokenizer, before it normalises them and after.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class WordTable:
    """Distinct word -> its ids as little-endian 32-bit bytes, in two halves. When the newer one is full the older one is
    dropped and takes its place, and words that are met again move to the new one: words in use are not learned anew, and
    what is forgotten only costs time."""

    def __init__(self, path: str, max_entries: int = 400_000, max_key: int = 256) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        for probe in ("a b", "a\nb", "a\tb", " a  b ", "é, B!", "a\x0bb\x0cc\rd"):
            joint = self.tokenizer.encode(probe, add_special_tokens=False).ids
            if joint != [i for w in probe.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
                raise ValueError(f"{path} doesn't drop white space; words can't be encoded apart")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.max_entries, self.max_key = max_entries, max_key

    def _each(self, words: list[bytes]) -> list[bytes]:
        """Words one by one."""
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False) if words else []
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _joint(self, words: list[bytes]) -> list[bytes] | None:
        """Words of letters alone: each is one run for the tokenizer, whose last piece is marked as an end of a word, so
        all are encoded as one text and cut at these marks. None if that doesn't give one run a word."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return None
        raw, starts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(starts, starts[1:])]

    def _letters(self, stems: list[bytes]) -> list[bytes]:
        """Those in which the tokenizer sees letters alone, once it has normalised them: marks that it takes off a letter
        would run on with those behind the word."""
        found = [(s, s.decode()) for s in stems]
        found = [(s, t) for s, t in found if t.isalpha()]
        normal = self.tokenizer.normalizer.normalize_str(" ".join(t for _, t in found)).split(" ")
        if len(normal) != len(found):
            normal = [self.tokenizer.normalizer.normalize_str(t) for _, t in found]
        return [s for (s, _), t in zip(found, normal, strict=True) if t.isalpha()]

    def _words(self, texts: list[str | None]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The words of all texts in a row, and how many there are up to the end of each text. Marks behind a word of Latin
        letters are a word of their own, as they are a run of their own for the tokenizer. ASCII letters are lowered, as it
        does, in texts without marks that join them and without its added tokens, which it takes as they are written."""
        raw = [(r, r.lower()) for r in (t.encode() if t else b"" for t in texts)]
        plain = lambda r, low: b"\xcc" not in r and b"\xcd" not in r and not any(a in low for a in self.added)  # noqa: E731  (such marks begin with these bytes)
        raw = [low if plain(r, low) else r for r, low in raw]
        joint = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = _KIND[joint]
        latin = np.flatnonzero(joint == 0xC3)
        latin = latin[(joint[latin + 1] != 0x97) & (joint[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        at = np.flatnonzero((kind[:-1] == _LETTER) & (kind[1:] == _MARK)) + 1
        other = np.flatnonzero(kind != _MARK)
        at = at[kind[other[np.searchsorted(other, at)]] == _SPACE]
        outside = np.concatenate([[-1], np.flatnonzero(kind != _LETTER)])  # the last byte is a space, and what a word begins after must be
        before = outside[np.searchsorted(outside, at) - 1]
        at = at[kind[before] == _SPACE]
        inside = kind != _SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[at] = True
        ends = np.searchsorted(np.flatnonzero(first), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
        letters = joint[inside]
        bounds = np.append(np.flatnonzero(first[inside]), len(letters))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]), ends

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        words, ends = self._words(texts)
        if not len(words):
            return [b""] * len(texts)
        words = words.dictionary_encode()
        found = pa.array(self._find(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        cuts = np.frombuffer(found.buffers()[1], np.int64)[[0, *ends]].tolist()
        whole = memoryview(found.buffers()[2] or b"")
        return [bytes(whole[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _find(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = [*map(self.ids.get, words)]
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.ids) + len(new) > self.max_entries // 2:
            self.older, self.ids = self.ids, {}
            new = range(len(words))
        ids, older = self.ids, self.older
        kept = [words[i] for i in new]
        ids.update([(w, older[w]) for w in kept if w in older])
        kept = [w for w in kept if w not in ids]
        self._learn([w for w in kept if len(w) <= self.max_key])
        long = [w for w in kept if len(w) > self.max_key]
        long = dict(zip(long, self._each(long), strict=True))
        for i in new:
            found[i] = ids.get(words[i]) or long.get(words[i], b"")
        return found

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters are learned together. Any other of letters and marks at its end has the ids of the letters and of
        the marks, as the tokenizer parts them."""
        ids = self.ids
        group = list(filter(_LATIN, words))
        found = self._joint(group)
        ids.update(zip(group, found or self._each(group), strict=True))
        words = [w for w in words if w not in ids]
        stems = [w.rstrip(_TAIL) for w in words]
        group = self._letters(list({s for s in stems if s}))
        found = self._joint(group)  # None if there is a letter that this library doesn't take for one
        known = dict(zip(group, found, strict=True)) if found else {}
        parted = [(w, s, w[len(s) :]) for w, s in zip(words, stems, strict=True) if s in known]
        whole = list({t for _, _, t in parted if t} | {w for w, s in zip(words, stems, strict=True) if s not in known})
        known |= zip(whole, self._each(whole), strict=True)
        ids.update([(w, known[w]) for w in words if w in known])
        ids.update([(w, known[s] + known[t] if t else known[s]) for w, s, t in parted])


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]):
        table = word_table(path)
        for batch in text_slices(batches, max_bytes=2 << 20):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own in enumerate(table.encode(batch.column("text").to_pylist())):
                all_ids = memoryview(own + end)
                for p, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = {"id": batch.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's tokens and the end id, cut if over capacity."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# A plan is a list of (bins, pattern): so many bins, each with the lengths of the pattern in this order.
Plan = list[tuple[int, tuple[int, ...]]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit over lengths in descending order, all bins that look alike at once."""
    groups: dict[int, list[list]] = {}  # room -> [bins, pattern as a linked list]
    rooms: list[int] = []  # sorted

    def put(room: int, bins: int, pattern) -> None:
        if bins:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([bins, pattern])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full = n // each
                put(capacity - each * size, full, ((size, each), None))
                if n % each:
                    put(capacity - n % each * size, 1, ((size, n % each), None))
                break
            room = rooms[at]
            bins, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // size
            full = min(bins, n // each)
            put(room - each * size, full, ((size, each), pattern))
            n -= full * each
            bins -= full
            if bins and 0 < n < each:
                put(room - n * size, 1, ((size, n), pattern))
                bins, n = bins - 1, 0
            put(room, bins, pattern)
    plan: Plan = []
    for held in groups.values():
        for bins, pattern in held:
            flat: list[int] = []
            while pattern:
                (size, each), pattern = pattern
                flat[:0] = [size] * each
            plan.append((bins, tuple(flat)))
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by lengths of which no two (with what must join them) fit together."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    many, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    k = np.concatenate([[0], sizes[:half]])
    top = np.maximum(np.searchsorted(sizes, capacity - k, side="right"), half)
    low = np.searchsorted(sizes, k)
    # Lengths over the half are a bin each; what is at least k and no more than the half fits into those of at most capacity - k alone.
    room = (many[top] - many[half]) * capacity - (volume[top] - volume[half])
    more = np.maximum(0, -(-(volume[half] - volume[low] - room) // capacity))
    return int(max(-(-volume[-1] // capacity), (many[-1] - many[half] + more).max()))


class _Spent(Exception):
    """A search has no work left."""


class Work:
    """What a search may still spend, in lengths looked at."""

    def __init__(self, left: float = float("inf")) -> None:
        self.left = left

    def spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise _Spent


def fillings(counts: dict[int, int], room: int, least: int = 0, work: Work | None = None) -> Iterator[tuple[int, ...]]:
    """The ways to fill the room with a sum of at least `least`, least waste first and then those of more and smaller pieces (best
    fit takes large ones, so this looks elsewhere), that are not seen to be dominated: by one that takes another piece, or a larger one in place of a piece or of two."""
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    work = work or Work()
    work.spend(len(counts))
    if not sizes:
        if least <= 0:
            yield ()
        return
    mask = (1 << room + 1) - 1
    reach = [1] * (len(sizes) + 1)  # reach[i]: the sums that sizes[i:] can have, as bits
    for i in range(len(sizes) - 1, -1, -1):
        sums, s, more, step = reach[i + 1], sizes[i], min(counts[sizes[i]], room // sizes[i]), 1
        while more:
            take = min(step, more)
            sums |= sums << take * s & mask
            more -= take
            step *= 2
        reach[i] = sums

    def sums_to(i: int, left: int) -> Iterator[tuple[int, ...]]:
        """Pieces of sizes[i:] with exactly this sum, in ascending order of tuples."""
        if not left:
            yield ()
            return
        while reach[i] >> left & 1:
            work.spend(1)
            s = sizes[i]
            for k in range(min(counts[s], left // s), 0, -1):
                if reach[i + 1] >> left - k * s & 1:
                    for rest in sums_to(i + 1, left - k * s):
                        yield (s,) * k + rest
            i += 1

    def dominated(x: tuple[int, ...], waste: int) -> bool:
        used = Counter(x)

        def left_within(low: int, high: int) -> bool:
            """Whether a piece of low to high is left."""
            for s in sizes[bisect.bisect_left(sizes, low) : bisect.bisect_right(sizes, high)]:
                work.spend(1)
                if counts[s] > used[s]:
                    return True
            return False

        if left_within(1, waste) or waste and any(left_within(s + 1, s + waste) for s in used):
            return True
        work.spend(len(used) ** 2)
        pairs = {a + b for a in used for b in used if a < b or a == b and used[a] > 1}
        return any(left_within(p, p + waste) for p in pairs)

    for total in range(room, max(least, 0) - 1, -1):
        if reach[0] >> total & 1:
            for x in sums_to(0, total):
                if not dominated(x, room - total):
                    yield x


def complete_bins(counts: dict[int, int], capacity: int, max_work: int = 4_000_000, incumbent_every: int = 8) -> tuple[Plan, dict]:
    """A plan with as few bins as found, and how it was found (bins, best-fit bins, lower bound, nodes, whether proven)."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    n_best, bound = sum(b for b, _ in best), lower_bound(counts, capacity)
    start, nodes, work = n_best, 0, Work(max_work)

    def moves(left: dict[int, int], bins: int, after: tuple | None) -> Iterator[tuple[int, tuple[int, ...], tuple]]:
        """How to close bins around the largest piece: how many, the pattern, and its place in the order of patterns."""
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        room = capacity - largest
        spare = (n_best - 1 - bins) * capacity - sum(s * n for s, n in left.items())
        for extra in fillings(rest, room, room - spare, work):
            place = (room - sum(extra), extra)
            work.spend(len(extra) + 1)
            if after and place <= after:
                continue  # the other order of the same bins was tried before
            need = Counter((largest, *extra))
            most = min(left[s] // k for s, k in need.items())
            for times in range(min(most, spare // place[0]) if place[0] else most, 0, -1):
                yield times, (largest, *extra), place

    # Depth first. A frame: the moves not yet tried, the bins closed and the pieces left before them.
    frames: list[tuple] = [(moves(counts, 0, None), 0, counts)] if n_best > bound else []
    taken: Plan = []
    try:
        while frames and n_best > bound:
            options, bins, left = frames[-1]
            move = next(options, None)
            if move is None:
                frames.pop()
                if taken:
                    taken.pop()
                continue
            times, pattern, place = move
            nodes += 1
            work.spend(len(left) + 500)
            need = Counter(pattern)
            after = {s: n - times * need[s] for s, n in left.items() if n > times * need[s]}
            bins += times
            taken.append((times, pattern))
            if bins + (lower_bound(after, capacity) if after else 0) >= n_best:
                taken.pop()
                continue
            if not after or nodes % incumbent_every == 1:
                work.spend(4 * len(after))
                rest = best_fit_decreasing(after, capacity)
                if bins + sum(b for b, _ in rest) < n_best:
                    best, n_best = [*taken, *rest], bins + sum(b for b, _ in rest)
            if after:
                frames.append((moves(after, bins, place if max(after) == pattern[0] else None), bins, after))
            else:
                taken.pop()
    except _Spent:
        pass
    return best, {"bins": n_best, "best_fit_bins": start, "lower_bound": bound, "nodes": nodes, "optimal": n_best == bound or not frames}


def place_table(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays sorted by first rank: first rank, pieces a bin, first sequence, offset of the first piece."""
    plan = sorted(plan, key=lambda x: (x[1], x[0]))
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bins, pattern in plan:
        offset = 0
        for size, same in groupby(pattern):
            k = len(list(same))
            rows.setdefault(size, []).append((used.get(size, 0), k, sequence, offset))
            used[size] = used.get(size, 0) + bins * k
            offset += k * size
        sequence += bins
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def _place(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            size, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, each, seq, off = table[int(s)]
                g = np.searchsorted(first, rank[at], side="right") - 1
                own = rank[at] - first[g]
                sequence[at] = seq[g] + own // each[g]
                offset[at] = off[g] + own % each[g] * s
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def place_pieces(pieces: DataFrame, capacity: int = 4096, salts: int = 64, max_work: int = 4_000_000, most_rows: int = 1_000_000) -> DataFrame:
    """pieces(id, piece, start, length, ids_crc32, ...) and sequence_id, offset. pieces is read three times, so it should
    be a written table. Pieces of one length are ranked in `salts` sub-groups, in more if these would hold over most_rows."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = place_table(complete_bins(counts, capacity, max_work)[0])
    many = {s: -(-n // most_rows) for s, n in counts.items() if n > salts * most_rows}
    own = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("length")], F.lit(salts)) if many else F.lit(salts)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), own).cast("int"))
    share = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = share.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"]).select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(_place(table), f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = materialize(token_pieces(df, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return place_pieces(pieces, capacity).withColumnRenamed("id", id_col)
