"""Settings of retrieval; the defaults are part of the semantics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Retrieval:
    """top_k hits of a pool of candidates; a type's quota is guaranteed before the rest is filled by score."""

    top_k: int = 8
    pool_size: int = 24
    fusion: str = "reciprocal_rerank"
    quotas: dict[str, int] = field(default_factory=lambda: {"endpoint": 2, "controller-context": 1, "db-collection": 1})
    rerank: bool = True
    #: The pool quota is applied before the rerank by default, where it guarantees nothing after the final cut.
    quota_after_rerank: bool = False

    def sized(self, top_k: int | None = None) -> tuple[int, int]:
        """(top_k, pool); 0 means the default."""
        k = top_k or self.top_k
        return k, max(self.pool_size, k)


@dataclass(frozen=True)
class CodeIndex:
    """Retrieval from a repository's code index."""

    top_k: int = 8
    pool_size: int = 24
    fusion: str = "reciprocal_rerank"
    quotas: dict[str, int] = field(default_factory=dict)
    priority_order: tuple[str, ...] = ()
    min_category_chars: int = 0
    min_category_extra: int = 0
    hint_boost: float = 1.0
    category_map: dict[str, str] = field(default_factory=dict)
    overview_suffix: str = " (overview)"
    rerank: bool = False


def load(path: str | None = None) -> Retrieval:
    """From a JSON object of the fields' names; a missing file gives all defaults, an unknown field is an error."""
    if path is None or not Path(path).exists():
        return Retrieval()
    given = json.loads(Path(path).read_text())
    unknown = given.keys() - {f.name for f in fields(Retrieval)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Retrieval(**given)
