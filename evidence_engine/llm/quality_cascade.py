"""Quality rules as a short-circuit cascade.

A bounded sample tells for every rule what it costs a row and which share it rejects; rules then run in the
order of rejections per cost, each only on rows that all earlier ones let pass. A row is kept if no rule
rejects it, so the order changes the time and never the result. What a rule needs to know of a text is found
when the first rule asks for it, and for the rows asked for only; judge() reports the base features and so finds these for
all rows, while for keep_good() the two conditions of the base are rules among the others.

Words are runs of `[^\\x20\\x09-\\x0D]` in the whole text. Repeated 8-word windows are found exactly: windows of
1, 2, 4 and 8 words get numbers by pairing the numbers of their halves, for many texts at once.

Edge cases: a null or blank text has no words and fails the base; repeated rows are judged alike; null ids and
extra columns are carried or left out as asked; an empty table gives an empty result.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import text_slices

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Rows that the estimate of costs and selectivities reads.
SAMPLE_ROWS = 2000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


class Texts:
    """Some texts and what is known of them so far."""

    def __init__(self, text: list[str]) -> None:
        self.text, self.raw = text, [t.encode() for t in text]
        self._words: dict[int, list[bytes]] = {}
        self._found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        return cls([t or "" for t in texts])

    def all(self) -> np.ndarray:
        return np.arange(len(self.text))

    def words(self, i: int) -> list[bytes]:
        if i not in self._words:
            self._words[i] = self.raw[i].split()  # bytes.split() knows just the six ASCII white spaces
        return self._words[i]

    def get(self, name: str, at: np.ndarray) -> np.ndarray:
        """A feature of the texts at these places."""
        value, known = self._found.setdefault(name, (np.zeros(len(self.text), np.int64), np.zeros(len(self.text), bool)))
        new = at[~known[at]]
        if len(new):
            value[new], known[new] = FEATURES[name](self, new), True
        return value[at]


def _each(one: Callable[[Texts, int], int]) -> Callable[[Texts, np.ndarray], np.ndarray]:
    return lambda x, at: np.array([one(x, i) for i in at.tolist()], np.int64)


def _lines(x: Texts, i: int) -> list[str]:
    """The lines that hold a word."""
    return [s for s in x.text[i].split("\n") if s.strip(SPACES)]


def _dup_lines(x: Texts, i: int) -> int:
    if "\n" not in x.text[i]:
        return 0
    lines = _lines(x, i)
    return len(lines) - len(set(lines))


def _repeats(x: Texts, at: np.ndarray) -> np.ndarray:
    words = [x.words(i) for i in at.tolist()]
    return repeated_words(words, np.array([len(w) for w in words], np.int64))


FEATURES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "n_words": _each(lambda x, i: len(x.words(i))),
    "word_chars": _each(lambda x, i: len(x.text[i]) - sum(map(x.text[i].count, SPACES))),
    "n_symbols": _each(lambda x, i: sum(map(x.text[i].count, SYMBOLS))),
    "n_dup_lines": _each(_dup_lines),
    "n_repeat_words": _repeats,
    "n_lines": _each(lambda x, i: len(_lines(x, i)) if "\n" in x.text[i] else int(bool(x.words(i)))),
}


def repeated_words(words: list[list[bytes]], n_words: np.ndarray) -> np.ndarray:
    """For each text its words in windows that it holds twice or more."""
    numbers = _Numbers()
    ids = np.fromiter((x for w in words for x in map(numbers.__getitem__, w)), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(words)), n_words)
    out = np.zeros(len(words), np.int64)
    if len(ids) < WINDOW:
        return out
    span = 1
    while span < WINDOW:
        ids = pd.factorize(ids[:-span] * (ids.max() + 1) + ids[span:])[0]
        span *= 2
    inside = np.flatnonzero(doc[: len(ids)] == doc[WINDOW - 1 :])
    if not len(inside):
        return out
    group = pd.factorize(ids[inside] * len(words) + doc[inside])[0]
    twice = inside[np.bincount(group)[group] > 1]
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words)).astype(np.int64)


#: A rule takes texts and the positions to judge, and says which of these it rejects.
Rule = Callable[[Texts, np.ndarray], np.ndarray]


def _ratio(top: str, most: float) -> Rule:
    return lambda x, at: x.get(top, at) > most * x.get("n_words", at)


def _word_length(x: Texts, at: np.ndarray) -> np.ndarray:
    mean = x.get("word_chars", at) / np.maximum(1, x.get("n_words", at))
    return (mean < 2.5) | (mean > 12)


def _line_share(holds: Callable[[str], bool], most: float) -> Rule:
    """Too many lines for which it holds."""
    return lambda x, at: np.array([sum(map(holds, x.text[i].split("\n"))) > most * n for i, n in zip(at.tolist(), x.get("n_lines", at).tolist(), strict=True)], bool)


_DIGITS, _CAPITALS, _LETTERS = b"0123456789", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def _share(of: bytes, most: float) -> Rule:
    """Share of the bytes of the text that are in a set."""
    return lambda x, at: np.array([len(x.raw[i]) - len(x.raw[i].translate(None, of)) > most * len(x.raw[i]) for i in at], bool)


def _letterless(x: Texts, at: np.ndarray) -> np.ndarray:
    """Too many words without a letter."""
    return np.array([sum(1 for w in x.words(i) if w.translate(None, _LETTERS) == w) > 0.4 * len(x.words(i)) for i in at.tolist()], bool)


def _stutter(x: Texts, at: np.ndarray) -> np.ndarray:
    """Too many words that repeat the one before."""
    return np.array([sum(map(bytes.__eq__, x.words(i), x.words(i)[1:])) > 0.2 * len(x.words(i)) for i in at.tolist()], bool)


def _compressible(x: Texts, at: np.ndarray) -> np.ndarray:
    return np.array([len(x.raw[i]) >= 1000 and len(zlib.compress(x.raw[i], 1)) < 0.12 * len(x.raw[i]) for i in at], bool)


#: The conditions of the base.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda x, at: x.get("n_words", at) < 20,
    "repeats": lambda x, at: 100 * x.get("n_repeat_words", at) > 30 * x.get("n_words", at),
}
RULES: dict[str, Rule] = {
    "symbols": _ratio("n_symbols", 0.1),
    "word_length": _word_length,
    "duplicate_lines": lambda x, at: 2 * x.get("n_dup_lines", at) > x.get("n_lines", at),
    "ellipses": _line_share(lambda s: s.rstrip(SPACES).endswith(("...", "…")), 0.3),
    "bullets": _line_share(lambda s: s.lstrip(SPACES).startswith(("-", "•", "·", "‣")), 0.9),
    "digits": _share(_DIGITS, 0.3),
    "capitals": _share(_CAPITALS, 0.4),
    "letterless": _letterless,
    "stutter": _stutter,
    "compressible": _compressible,
}


def _failed(x: Texts) -> np.ndarray:
    return np.logical_or.reduce([rule(x, x.all()) for rule in BASE_RULES.values()])


def _measure(rules: dict[str, Rule], after_base: bool):
    def run(batches: Iterable[pa.RecordBatch]):
        cost, no = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            x = Texts.of(texts)
            at = np.flatnonzero(~_failed(x)) if after_base else x.all()
            for name, rule in rules.items():
                own = x if after_base else Texts.of(texts)  # what the base has found costs nothing after it
                began = time.perf_counter()
                no[name] += int(rule(own, at).sum())
                cost[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "cost": list(cost.values()), "rejected": list(no.values())})

    return run


def rule_order(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS, after_base: bool = True) -> list[str]:
    """The rules' names by rejections per cost in a sample of about sample_rows rows, most first; of rows that pass the
    base, or of all."""
    rules = rules or RULES
    share = min(1.0, sample_rows / max(1, df.count()))
    found = df.select(F.col(text_col).cast("string").alias("text")).sample(fraction=share, seed=7).mapInArrow(_measure(rules, after_base), "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    rate = {r["rule"]: r["rejected"] / (r["cost"] + 1e-6) for r in found}
    return sorted(rules, key=lambda n: -rate.get(n, 0.0))


def _judge(rules: dict[str, Rule], order: list[str], keep: list[str]):
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            x = Texts.of(batch.column("text").to_pylist())
            failed = _failed(x)
            at = np.flatnonzero(~failed)
            for name in order:
                if not len(at):
                    break
                at = at[~rules[name](x, at)]
            kept = np.zeros(len(failed), bool)
            kept[at] = True
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(x.get(b, x.all())) for b in BASE), pa.array(failed), pa.array(kept)], names=[*names, *BASE, "base_failed", "kept"])

    return run


def judge(df: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",), rules: dict[str, Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """The kept columns, the base features, base_failed and kept (no rule rejects it), for every row."""
    rules, keep = rules or RULES, list(keep)
    order = order or rule_order(df, text_col, rules)
    slim = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    kinds = "".join(f"_k{i} {slim.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    got = slim.mapInArrow(_judge(rules, order, keep), kinds + "".join(f"{b} long, " for b in BASE) + "base_failed boolean, kept boolean")
    return got.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *BASE, "base_failed", F.col("kept").alias("kept"))


def _passing(rules: dict[str, Rule], order: list[str], text: str):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            start = 0
            for part in text_slices([pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], ["text"])]):
                x = Texts.of(part.column(0).to_pylist())
                good = x.all()
                for name in order:
                    if not len(good):
                        break
                    good = good[~rules[name](x, good)]
                if len(good):
                    yield batch.take(pa.array(start + good))
                start += part.num_rows

    return run


def keep_good(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows of df, all columns, that pass the base and every rule."""
    rules = BASE_RULES | (rules or RULES)
    return df.mapInArrow(_passing(rules, order or rule_order(df, text_col, rules, after_base=False), text_col), df.schema)
