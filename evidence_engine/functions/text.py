"""Text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
HAN = "[一-鿿]"
_LEFT, _RIGHT = r"^\p{IsWhite_Space}+", r"\p{IsWhite_Space}+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends (F.trim knows spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, _LEFT, ""), _RIGHT, "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; a run with a Han character also gives its character
    bigrams, so that a run of two such characters comes twice. Texts without a Han character skip the bigrams' lambdas."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))

    def grams(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda p: F.substring(run, p, F.lit(2)))
        return F.when(run.rlike(HAN) & (F.char_length(run) > 1), F.concat(F.array(run), pairs)).otherwise(F.array(run))

    return F.when(text.rlike(HAN), F.flatten(F.transform(runs, grams))).otherwise(runs)


def answer_tokens(text: Column) -> Column:
    """Single letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_])"), F.lit(1))


def without_space(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\p{IsWhite_Space}+", ""))


def alnum_or_han(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]", ""))


def char_grams(text: Column, phrases: tuple[str, ...] = (), n: int = 4) -> Column:
    """Distinct n-grams of the characters of alnum_or_han(text) once the phrases are taken out, one after another."""
    left = alnum_or_han(text)
    for p in phrases:
        left = F.replace(left, F.lit(p.lower()), F.lit(""))
    # A look-ahead at every place, so that the text is gone through once; what is left has no character beyond 16 bits.
    grams = F.regexp_extract_all(left, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))


def searchable_text(transcript: Column, caption: Column) -> Column:
    part = lambda tag, c: F.when(~blank(c), F.concat(F.lit(f"{tag} "), strip(c)))
    return F.concat_ws("\n", part("[ASR]", transcript), part("[视觉]", caption))


def strip_markup(html: Column) -> Column:
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def safe_filename(ordinal: Column, title: Column, suffix: Column, longest: int = 100) -> Column:
    """Ordinal, the title's plain characters with underscores for all else, and an allowed suffix (.webm if another)."""
    stem = F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    kind = F.when(suffix.isin(".mp4", ".webm", ".ogv", ".ogg"), suffix).otherwise(".webm")
    number = F.when(F.char_length(ordinal.cast("string")) < 3, F.lpad(ordinal.cast("string"), 3, "0")).otherwise(ordinal.cast("string"))
    return F.concat(number, F.lit("_"), F.substring(F.when(stem == "", "mandarin_news").otherwise(stem), 1, longest), kind)


def video_identifier(stem: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"), F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 8))


def frame_identifier(video_id: Column, timestamp: Column, path: Column) -> Column:
    key = F.concat(video_id, F.lit("\0"), F.format_string("%.3f", timestamp), F.lit("\0"), path)
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 24)


def video_of_segment(segment_id: Column) -> Column:
    return F.regexp_replace(segment_id, "_[^_]*$", "")


def json_array_in(text: Column) -> Column:
    """The JSON array in a model's answer, from the first bracket to the last, code fences and prose around it taken off;
    null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(F.json_array_length(found).isNotNull(), found)


def rerank_document(segment_id: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("Segment ID: %s\nTime: %.3f-%.3f seconds\n%s", segment_id, start, end, text)


def token_overlap(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's distinct tokens that are among the tokens; 0 without any."""
    asked = F.array_distinct(query_tokens)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens)) / F.size(asked)).otherwise(0.0)
