"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding: compatibility forms and case are unified, invisible characters removed, look-alike letters of other
scripts and digits that stand for letters replaced. A text with digits beside letters is matched in two
readings, with 1 as i and as l. Everything but letters parts words.

The lexicon is learned: of the beginnings of words (of 4 to 12 letters; words of 2 or 3 letters whole) in texts labelled
toxic those are kept that all but never begin a word of a text labelled otherwise, each as long as it can be without losing
texts. How often they occur doesn't matter as such: an entry needs evidence of 11.5 nats against the other texts, which takes
some 8 toxic texts where a quarter is toxic. An entry's weight is its log likelihood ratio. Of these the ones stay that
explain at least 3 texts (or one in 500 of the toxic ones) which more frequent ones don't; what merely comes along with
toxic words would flag clean texts. A toxic part inside or at the end of a longer word is no entry. Entries within an
exception phrase don't count.

The score is a logistic function of the weight found and of the weight by length, both as logarithms,
fitted on the sample that the lexicon was learned from. Learning reads a bounded sample of labelled rows
(`max_positive`, `max_negative`), the first in the order of a hash; scoring reads every whole text.

Edge cases: null and empty texts score as texts without a match; null labels and ids are not learned from;
of several labels of an id the largest counts, of several texts of an id the least is learned from; without any toxic label nothing is matched and all scores are
0; repeated rows score alike; extra columns are passed by.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import materialize, text_slices

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдезіјкмнорсԁтухѕӏԛԝαβεηικνορτυχ", "abbrgeзijkmhopcdtyxslqwabenikvoptux", strict=True))
# Characters written for letters; 1 is read as i and as l.
DIGITS = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# Harmless phrases that may hold an entry.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "white trash cans", "circus clown")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]")
_ONE = re.compile(r"[^\W\d_]1|1[^\W\d_]")
_LEET = re.compile(r"[0-9@$]")
_MIXED = re.compile(r"[^\s.,;:!?()\[\]{}\"*#%&|<>/\\+=_-]*[^\W\d_][^\s.,;:!?()\[\]{}\"*#%&|<>/\\+=_-]*")
_ASCII_PART = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + bytes(range(128, 256))
_PART = re.compile(r"[\W\d_]+")


def fold(text: str, one: str = "i") -> str:
    """Words of letters, each after a single space."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold()
        text = text.translate(_HOMOGLYPH_TABLE)
    if _LEET.search(text):
        table = _LEET_TABLES[one]
        text = _MIXED.sub(lambda m: _unleet(m[0], table), text)
    if text.isascii():
        return " " + " ".join(text.encode().translate(_ASCII_PART).decode().split())
    return " " + " ".join(_PART.sub(" ", text).split())


def _unleet(word: str, table: dict[int, str]) -> str:
    """A word with digits or signs among its letters; signs at its ends are marks."""
    core = word.strip("$@")
    return core.translate(table) if _LEET.search(core) else core


_HOMOGLYPH_TABLE = str.maketrans(HOMOGLYPHS)
_LEET_TABLES = {one: str.maketrans(DIGITS | {"1": one}) for one in "il"}


def readings(text: str | None) -> list[str]:
    text = text or ""
    first = fold(text)
    return [first, fold(text, "l")] if _ONE.search(text) else [first]


def beginnings(text: str | None, shortest: int, longest: int) -> set[str]:
    """Of all words; words too short for one stand whole, with the space behind them."""
    words = {w for r in readings(text) for w in r.split()}
    return {w[:k] for w in words for k in range(shortest, min(len(w), longest) + 1)} | {w + " " for w in words if 2 <= len(w) < shortest}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coef: tuple[float, float, float]  # constant, log weight, log weight by length

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            key = fold(phrase) + " "
            found.add_word(key, (len(key), None))
        found.make_automaton()
        return found


def features(text: str | None, automaton) -> tuple[float, float]:
    """log(1 + weight) and log(1 + weight in 100 words)."""
    best, words = 0.0, 1
    if len(automaton):
        for reading in readings(text):
            hits, spans = {}, []
            for end, (length, weight) in automaton.iter(reading + " "):
                if weight is None:
                    spans.append((end - length + 1, end))
                else:
                    start = end - length + 1
                    hits[start] = max(hits.get(start, 0.0), weight)
            total = sum(w for s, w in hits.items() if not any(a <= s <= b for a, b in spans))
            if total > best:
                best, words = total, max(1, reading.count(" "))
    return math.log1p(best), math.log1p(100 * best / words)


def _count(shortest: int, longest: int, among: frozenset[str] | None):
    def run(batches: Iterable[pa.RecordBatch]):
        found: Counter[str] = Counter()
        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                own = beginnings(text, shortest, longest)
                found.update(own if among is None else own & among)
                if len(found) > 500_000:
                    yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})
                    found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})

    return run


def _features(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]):
        automaton = lexicon.automaton()
        for batch in text_slices(batches):
            x = [features(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["toxic", "a", "b"])

    return run


#: Nats that an entry's counts must tell for it.
EVIDENCE = 11.5


def choose_terms(positive: dict[str, int], negative: dict[str, int], n_pos: int, n_neg: int, evidence: float = EVIDENCE) -> dict[str, float]:
    """Entries and weights from the numbers of texts with each beginning of a word."""

    def pure(t: str) -> float:
        p, n = positive[t], negative.get(t, 0)
        share = n_pos / (n_pos + n_neg)
        ratio = (p + 0.5) / (n_pos + 1) / ((n + 0.5) / (n_neg + 1))
        strong = p * math.log(p / (p + n) / share) + (n * math.log(n / (p + n) / (1 - share)) if n else 0.0)
        return math.log(ratio) if strong >= evidence and p > n and 50 * n <= p * n_neg / n_pos else 0.0

    longer: dict[str, list[str]] = {}
    for t in positive:
        longer.setdefault(t[:-1], []).append(t)
    out: dict[str, float] = {}
    for t in sorted(positive, key=lambda t: (len(t), t)):
        if any(t[:k] in out for k in range(1, len(t))) or not pure(t):
            continue
        while more := [x for x in longer.get(t, []) if positive[x] >= 0.9 * positive[t] and pure(x)]:
            t = max(more, key=lambda x: (positive[x], x))
        out[t] = pure(t)
    return out


def covering(hits: list[frozenset[str]], weights: dict[str, float], least: int) -> dict[str, float]:
    """The entries that explain texts which more frequent ones don't (at least so many), or that are in over a fiftieth of all.
    What merely comes along with toxic words, as in copies of a text, goes."""
    by: dict[str, set[int]] = {}
    for i, h in enumerate(hits):
        for t in h:
            by.setdefault(t, set()).add(i)
    seen: set[int] = set()
    out: dict[str, float] = {}
    for t in sorted(by, key=lambda t: (-len(by[t]), t)):
        if len(by[t] - seen) >= least or 50 * len(by[t]) > len(hits):
            out[t] = weights[t]
            seen |= by[t]
    return out


def _entries(weights: dict[str, float], shortest: int, longest: int):
    """The entries of each text, those that begin one of its words."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"terms": [sorted(t for t in beginnings(x, shortest, longest) if t in weights) for x in batch.column("text").to_pylist()]})

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; weights of features are kept from being negative by dropping them."""
    design = np.column_stack([np.ones(len(x)), x])
    use = np.ones(3, bool)
    while True:
        beta = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (y - p) - ridge * beta
            hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3)
            step = np.zeros(3)
            step[use] = np.linalg.solve(hess[np.ix_(use, use)], grad[use])
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        bad = (beta < 0) & use & np.array([False, True, True])
        if not bad.any():
            return beta
        use &= ~bad


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_negative: int = 12000, shortest: int = 4, longest: int = 12, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """From docs(doc_id, text) and labels(doc_id, toxic): a lexicon, learned from at most max_positive and max_negative texts."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    marked = marked.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    picked = marked.where("toxic > 0").orderBy("order", "doc_id").limit(max_positive).unionByName(marked.where("toxic <= 0").orderBy("order", "doc_id").limit(max_negative)).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # max_positive + max_negative ids at most
    sample = materialize(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos:
        return Lexicon({}, exceptions, (-30.0, 0.0, 0.0))
    total = lambda rows: rows.groupBy("term").agg(F.sum("n").alias("n"))
    # No entry has less evidence than its toxic texts alone could give.
    least = max(3, math.ceil(EVIDENCE / math.log((n_pos + n_neg) / n_pos))) if n_neg else 3
    positive = {r["term"]: r["n"] for r in total(sample.where("toxic = 1").select("text").mapInArrow(_count(shortest, longest, None), "term string, n long")).where(F.col("n") >= least).collect()}  # of the sample's words
    negative = {r["term"]: r["n"] for r in total(sample.where("toxic = 0").select("text").mapInArrow(_count(shortest, longest, frozenset(positive)), "term string, n long")).collect()}  # positive's rows at most
    weights = choose_terms(positive, negative, n_pos, n_neg)
    if weights:
        hits = sample.where("toxic = 1").select("text").mapInArrow(_entries(weights, shortest, longest), "terms array<string>").where(F.size("terms") > 0).collect()  # max_positive rows at most
        weights = covering([frozenset(r["terms"]) for r in hits], weights, max(3, n_pos // 500))
    lexicon = Lexicon(weights, exceptions, (0.0, 0.0, 0.0))
    rows = sample.select("text", "toxic").mapInArrow(_features(lexicon), "toxic int, a double, b double").groupBy("toxic", "a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "a", "b").collect()  # the sample's rows at most
    x = np.array([[r["a"], r["b"]] for r in rows for _ in range(r["n"])])
    y = np.array([float(r["toxic"]) for r in rows for _ in range(r["n"])])
    return Lexicon(lexicon.weights, exceptions, tuple(float(v) for v in _fit(x, y)))


def _scores(lexicon: Lexicon, keep: list[str]):
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]):
        automaton = lexicon.automaton()
        c, wa, wb = lexicon.coef
        for batch in text_slices(batches):
            z = [c + wa * a + wb * b for a, b in (features(t, automaton) for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array([1 / (1 + math.exp(-max(-700.0, v))) for v in z], pa.float64())], names=[*names, "score"])

    return run


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and score, from 0 to 1, of every row."""
    keep = list(keep)
    slim = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    kinds = "".join(f"_k{i} {slim.schema[f'_k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return slim.mapInArrow(_scores(lexicon, keep), kinds + "score double").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "score")


def _below(lexicon: Lexicon, text: str, limit: float):
    def run(batches: Iterable[pa.RecordBatch]):
        automaton = lexicon.automaton()
        c, wa, wb = lexicon.coef
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = []
            for i in range(batch.num_rows):
                a, b = features(column[i].as_py(), automaton)
                if 1 / (1 + math.exp(-max(-700.0, c + wa * a + wb * b))) < limit:
                    at.append(i)
            if at:
                yield batch.take(pa.array(at, pa.int64()))

    return run


def keep_clean(df: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of df, all columns, with a score under limit."""
    return df.mapInArrow(_below(lexicon, text_col, limit), df.schema)
