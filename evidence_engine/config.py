"""Settings from TOML: one table declares every key; a reader checks a file against it."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path
from types import MappingProxyType
from typing import Any

NEEDED = object()

# Section, key, default (NEEDED: there is none). The kind of a value is that of its default, text without one.
KEYS: tuple[tuple[str, str, Any], ...] = (
    ("segmentation", "duration_seconds", 20.0),
    ("segmentation", "overlap_seconds", 5.0),
    ("retrieval", "sparse_top_k", 20),
    ("retrieval", "text_top_k", 20),
    ("retrieval", "vision_top_k", 20),
    ("retrieval", "fusion_top_k", 20),
    ("retrieval", "rerank_top_k", 3),
    ("retrieval", "rrf_k", 60),
    ("generation", "minimum_rerank_score", 0.20),
    ("generation", "allow_abstention", True),
    ("models", "text_embedding", NEEDED),
    ("models", "reranker", NEEDED),
    ("models", "vision_language", NEEDED),
    ("models", "clip", NEEDED),
    ("models", "whisper", NEEDED),
)

#: A problem that spans keys, and when it is there.
BETWEEN: tuple[tuple[str, Callable[[Mapping[str, Any]], bool]], ...] = (
    ("segmentation: windows must be longer than their overlap, which must not be negative", lambda s: not 0 <= s["segmentation.overlap_seconds"] < s["segmentation.duration_seconds"]),
    ("retrieval: every k must be positive", lambda s: any(v <= 0 for k, v in s.items() if k.startswith("retrieval."))),
)


def _kind(value: Any, default: Any) -> bool:
    if default is NEEDED:
        return isinstance(value, str) and bool(value.strip())
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    return isinstance(value, int) or isinstance(value, float) and isinstance(default, float)


def settings(raw: Mapping[str, Any]) -> Mapping[str, Any]:
    """"section.key" -> value of nested tables, read-only. Whatever is unknown, absent without a default, of another kind or out
    of range is named in one ValueError."""
    given = {f"{section}.{key}": v for section, own in raw.items() for key, v in (own.items() if isinstance(own, Mapping) else ((str(own), own),))}
    known = {f"{section}.{key}": default for section, key, default in KEYS}
    problems = [f"{k} is unknown" for k in given if k not in known]
    problems += [f"{k} is needed" for k, default in known.items() if default is NEEDED and k not in given]
    problems += [f"{k} has another kind: {v!r}" for k, v in given.items() if k in known and not _kind(v, known[k])]
    if not problems:
        found = {k: type(default)(given[k]) if k in given and default is not NEEDED else given.get(k, default) for k, default in known.items()}
        problems = [text for text, there in BETWEEN if there(found)]
    if problems:
        raise ValueError("; ".join(problems))
    return MappingProxyType(found)


def load_config(path: str | Path) -> Mapping[str, Any]:
    return settings(tomllib.loads(Path(path).read_text(encoding="utf-8")))
