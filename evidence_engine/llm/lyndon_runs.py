"""Periodic runs of words by Lyndon words.

A run is a maximal stretch that repeats with its smallest period. For one of the two orders of the words (a given one
and its reverse) it holds a Lyndon word of one period that is the longest to begin at its place; so each place gives
two candidates. A text is scanned from right to left with a stack: the longest Lyndon word at a place reaches to the
next place whose suffix is smaller, which the links of later places find. Suffixes that differ in their first words
are compared by these; others by their longest common extension, a binary search over rolling hashes, whose end
is verified on the words themselves (both sides of it; on failure the words are compared one by one). A candidate is then
extended to both sides in the same way, and a run that is long enough is verified word by word before it is returned; if one fails, hashes
have met and the text is scanned again with words in their place. There is no suffix array; work is n log n for n words, also in texts that repeat one word throughout.

What was found at a distance serves the next comparison at that distance, so a text that repeats one word asks few hashes.
Words are coded by the place where each first occurs, so order and equality are exact. Hashes are modulo 2**61 - 1.

Edge cases: a null or empty text has no words and no runs; a null id plants nothing; very long texts are scanned whole,
some 100 bytes a word; repeated rows give repeated rows; extra columns are passed by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable
from itertools import accumulate, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import text_slices

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
#: Words that are compared before hashes are asked.
DIRECT = 8
Run = tuple[int, int, int]

_powers = [1]


def codes(words: list[bytes]) -> list[int]:
    """For each word the place where it first occurs."""
    return list(map({}.setdefault, words, count()))


class Extensions:
    """Longest common extensions within a sequence of codes, to the right and to the left."""

    def __init__(self, x: list[int], hashed: bool = True) -> None:
        self.x, self.n, self.prefix, self.hashed = x, len(x), None, hashed
        #: By distance, where words were compared last, and the result.
        self.to_right: dict[int, tuple[int, int]] = {}
        self.to_left: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> list[int]:
        """Hashes of all beginnings, made when first asked for."""
        self.prefix = list(accumulate(self.x, lambda h, c: (h * BASE + c + 1) % PRIME, initial=0))
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * BASE % PRIME)
        return self.prefix

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether, by their hashes if asked so, the n words from i and from j on are the same."""
        if not self.hashed:
            return self.x[i : i + n] == self.x[j : j + n]
        h, p = self.prefix or self._hashes(), _powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % PRIME == 0

    def _search(self, k: int, most: int, same: Callable[[int], bool]) -> int:
        """The largest n from k to most for which same(n): wider steps at first, then halves."""
        good, bad, step = k, most + 1, DIRECT
        while good + 1 < bad:
            mid = min(good + step, bad - 1) if step else (good + bad) // 2
            good, bad, step = (mid, bad, 2 * step) if same(mid) else (good, mid, 0)
        return good

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are the same."""
        x, most = self.x, self.n - j
        k, short = 0, min(DIRECT, most)
        while k < short and x[i + k] == x[j + k]:
            k += 1
        if k < DIRECT or k == most:
            return k
        at, n = self.to_right.get(j - i, (self.n, 0))
        if 0 <= at - i <= k:  # the words up to those that were compared at this distance are the same
            n += at - i
        else:
            n = self._search(k, most, lambda n: self._same(i, j, n))
            if x[i + n - 1] != x[j + n - 1] or n < most and x[i + n] == x[j + n]:
                n = next((k for k in range(most) if x[i + k] != x[j + k]), most)
        self.to_right[j - i] = (i, n)
        return n

    def left(self, i: int, j: int) -> int:
        """How many words that end with i and with j > i are the same."""
        x, most = self.x, i + 1
        k, short = 0, min(DIRECT, most)
        while k < short and x[i - k] == x[j - k]:
            k += 1
        if k < DIRECT or k == most:
            return k
        at, n = self.to_left.get(j - i, (-1, 0))
        if 0 <= at - i < n:  # within what was found at this distance
            return n - (at - i)
        n = self._search(k, most, lambda n: self._same(i + 1 - n, j + 1 - n, n))
        if x[i - n + 1] != x[j - n + 1] or n < most and x[i - n] == x[j - n]:
            n = next((k for k in range(most) if x[i - k] != x[j - k]), most)
        self.to_left[j - i] = (i, n)
        return n


def candidates(x: list[int], ordered: list[int], extend: Extensions) -> Iterable[tuple[int, int, int]]:
    """(i, j, k) for places i whose longest Lyndon word under `ordered` ends before j, if it may repeat: the words from i and
    from j on share k, or those before them are the same. ordered gives x's order and ends with a number under all."""
    n = len(x)
    after = [n] * (n + 1)  # the next place whose suffix is smaller
    right = extend.right
    found = []
    for i in range(n - 1, -1, -1):
        a, j, k = ordered[i], i + 1, 0
        while True:
            b = ordered[j]
            if a > b:
                k = 0
                break
            if a == b:
                k = right(i, j)
                if ordered[i + k] > ordered[j + k]:
                    break
            j = after[j]
        after[i] = j
        if j < n and (k or i and x[i - 1] == x[j - 1]):
            found.append((i, j, k))
    return found


def is_run(x: list[int], start: int, length: int, period: int) -> bool:
    """Whether these words repeat with this period, and no neighbour carries it on."""
    end = start + length
    if start and x[start - 1] == x[start - 1 + period] or end < len(x) and x[end] == x[end - period]:
        return False
    return x[start : end - period] == x[start + period : end]


def runs(x: list[int], least: int = 24, exponent: int = 3, hashed: bool = True) -> list[Run]:
    """(start, length, period), ascending by start and period, of each run of at least `least` words and `exponent` >= 2
    periods."""
    n = len(x)
    if n < least or n < 2:
        return []
    extend = Extensions(x, hashed)
    found: set[Run] = set()
    for ordered in ([*x, -1], [*(-c for c in x), -n]):
        for i, j, k in candidates(x, ordered, extend):
            period = j - i
            before = extend.left(i - 1, j - 1) if i else 0
            length = before + period + k
            if length >= least and length >= exponent * period:
                found.add((i - before, length, period))
    if not all(is_run(x, *r) for r in found):
        if not hashed:
            raise AssertionError("a run that is none, without hashes")
        return runs(x, least, exponent, hashed=False)
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(found: list[Run]) -> Iterable[tuple[int, int]]:
    """The stretches, apart and ascending, of the words that a run holds after its first period."""
    now = None
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        if now and a <= now[1]:
            now = (now[0], max(now[1], b))
        else:
            if now:
                yield now
            now = (a, b)
    if now:
        yield now


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    kept, at = [], 0
    for a, b in dropped(found):
        kept += words[at:a]
        at = b
    return kept + words[at:]


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest exponent; of equal ones that of the smallest start, then period."""
    best = None
    for r in found:  # ascending by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which every tenth document repeats a stretch from some place to the end, as its id decides."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    stretch = words[a : a + p]
    return words[:a] + stretch * whole + stretch[:rest]


_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _scan(least: int, exponent: int, change: Callable[[list[bytes], object], list[bytes]] | None, with_runs: bool):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            out: list[tuple] = []
            spans: list[list[dict]] = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split() if text else []
                if change:
                    words = change(words, doc_id)
                found = runs(codes(words), least, exponent)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                best = strongest(found)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                kept = collapse(words, found) if found else words
                out.append((len(found), top[0], top[1], top[2], top[3], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
                if with_runs:
                    spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            names = [f.split()[0] for f in _FIELDS.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _FIELDS.split(", ")]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            if with_runs:
                names, cols = [*names, "runs"], [*cols, pa.array(spans, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", *names])

    return run


def scan(df: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text", change=None, with_runs: bool = False) -> DataFrame:
    """(id_col, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256[, runs]) of
    every row. change(words, id) may give other words in place of a text's own."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    spans = ", runs array<struct<start:long,length:long,period:long>>" * with_runs
    return slim.mapInArrow(_scan(least, exponent, change, with_runs), f"id {kind}, {_FIELDS}{spans}").withColumnRenamed("id", id_col)


def _collapsed(least: int, exponent: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = text.encode().split() if text else []
                found = runs(codes(words), least, exponent)
                out.append(b" ".join(collapse(words, found)).decode() if found else text)
            yield batch.set_column(batch.schema.names.index("text"), "text", pa.array(out, pa.string()))

    return run


def collapse_texts(df: DataFrame, least: int = 24, exponent: int = 3, text_col: str = "text") -> DataFrame:
    """df, all columns, with the words that runs repeat taken out of its texts; texts without runs stay as they are."""
    own = df.select(*(F.col(c).alias("text" if c == text_col else f"c_{c}") for c in df.columns))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    done = own.mapInArrow(_collapsed(least, exponent), kinds)
    return done.select(*(F.col("text" if c == text_col else f"`c_{c}`").alias(c) for c in df.columns))
