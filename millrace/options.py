"""Options with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchOptions:
    """Weights hold unless both are 0; a decay of 0 or less switches the recency factor off; a limit of 0 or less is 10."""

    vector_weight: float = 0.0
    text_weight: float = 0.0
    decay_days: float = 180.0
    candidates: int = 50
    limit: int = 10
    source_types: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    updated_after: str | None = None

    def weights(self) -> tuple[float, float]:
        return (0.6, 0.4) if self.vector_weight == 0 and self.text_weight == 0 else (self.vector_weight, self.text_weight)

    def also(self, source_types: list[str], projects: list[str], updated_after: str | None) -> SearchOptions:
        """These options with more filters; what both name is allowed, and a time in both is the later one."""
        later = max(filter(None, (self.updated_after, updated_after)), default=None)
        return replace(self, source_types=(*self.source_types, *source_types), projects=(*self.projects, *projects), updated_after=later)

    def __post_init__(self):
        if self.limit <= 0:
            object.__setattr__(self, "limit", 10)
        if self.limit > 50:
            raise ValueError("limit must be at most 50")


def checked_query(q: str) -> str:
    """A search text: not blank, at most 512 bytes."""
    q = q.strip()
    if not q or len(q.encode()) > 512:
        raise ValueError("a query has 1 to 512 bytes")
    return q


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 1000
    overlap_tokens: int = 150

    def __post_init__(self):
        if self.max_tokens < 1 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("overlap must be less than the budget")
