"""Settings, from defaults and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Words for yes and no.
_YES = ("true", "1", "yes", "on", "enabled")
_NO = ("false", "0", "no", "off", "disabled")


def parse_bool(text: str | None, default: bool) -> bool:
    word = (text or "").strip().lower()
    return True if word in _YES else False if word in _NO else default


def _env(name: str, default, kind=None):
    kind = kind or type(default)
    text = os.environ.get("QUARRYLOOM_" + name)
    if text is None or text == "":
        return default
    if kind is bool:
        return parse_bool(text, default)
    try:
        return kind(text)
    except ValueError:
        return default


@dataclass(frozen=True)
class SearchConfig:
    """Limits and weights of the three signals, and how they are fused."""

    keyword_limit: int = 30
    semantic_limit: int = 20
    symbol_limit: int = 10
    weights: dict[str, float] = field(default_factory=lambda: {"keyword": 0.3, "semantic": 0.5, "symbol": 0.2})
    rrf_k: int = 60
    rerank: bool = False
    rerank_top_k: int = 20
    rerank_threshold: float = 0.0

    @classmethod
    def from_env(cls) -> SearchConfig:
        base = cls()
        weights = {k: _env(f"WEIGHT_{k.upper()}", v) for k, v in base.weights.items()}
        return cls(*[_env(n.upper(), getattr(base, n)) for n in ("keyword_limit", "semantic_limit", "symbol_limit")], weights, _env("RRF_K", 60), _env("RERANK", False), _env("RERANK_TOP_K", 20), _env("RERANK_THRESHOLD", 0.0))


@dataclass(frozen=True)
class ChunkConfig:
    fallback_lines: int = 50
    fallback_overlap: int = 10
    line_lines: int = 30
    line_overlap: int = 15
    least_lines: int = 5
    least_gap: int = 3
    max_bytes: int = 2000
