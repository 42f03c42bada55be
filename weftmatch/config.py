"""Settings of the engine, with the admission rules for changing them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and weights of the similarity query."""

    threshold: float = 0.6
    whole_copy: float = 0.8
    weights: dict[str, float] = field(default_factory=lambda: {"cosine": 0.4, "winnowing": 0.4, "jaccard": 0.2})
    enabled: frozenset[str] = frozenset({"cosine", "winnowing", "jaccard"})
    k: int = 3
    window: int = 4
    min_cosine: float = 0.25
    min_winnowing: float = 0.1
    retention_days: int = 180
    extensions: tuple[str, ...] = (".docx", ".doc", ".pdf", ".txt")
    max_size: str = "50MB"

    def weight(self, name: str) -> float:
        """The weight in force: 0 if disabled; if nothing is left, the defaults 0.4, 0.4, 0.2."""
        own = {n: (w if n in self.enabled else 0.0) for n, w in self.weights.items()}
        return own[name] if sum(own.values()) > 0 else {"cosine": 0.4, "winnowing": 0.4, "jaccard": 0.2}[name]

    def problems(self) -> list[str]:
        """What is wrong with these settings; empty if they may be stored."""
        out = []
        if not 0.1 <= self.threshold <= 1:
            out.append("threshold must be between 0.1 and 1")
        if not 0.1 <= self.whole_copy <= 1:
            out.append("whole_copy must be between 0.1 and 1")
        if not self.enabled:
            out.append("at least one algorithm must be enabled")
        if any(not 0 <= self.weights[n] <= 1 for n in self.enabled):
            out.append("each weight must be between 0 and 1")
        elif sum(int(self.weights[n] * 100 + 0.5) for n in self.enabled) != 100:
            out.append("enabled weights must add up to 100 %")
        if not set(self.extensions) <= {".docx", ".doc", ".pdf", ".txt"}:
            out.append("unknown file extension")
        if not (m := re.fullmatch(r"(\d+)MB", self.max_size)) or not 1 <= int(m[1]) <= 100:
            out.append("max_size must be 1MB to 100MB")
        return out


def resolve_threshold(asked: float | None, config: EngineConfig | None) -> float:
    """The caller's threshold, else the configured one, else 0.5."""
    return asked if asked is not None else config.threshold if config is not None else 0.5
