"""Search settings and their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import QuillError

_RANGES = {
    "default_limit": (1, 100_000),
    "max_prefix_expansions": (1, 100_000),
    "max_fuzzy_expansions": (1, 100_000),
    "max_fuzzy_distance": (1, 4),
    "min_fuzzy_term_len": (1, 64),
    "segments_per_level": (2, 64),
}


@dataclass(frozen=True)
class SearchConf:
    """default_limit: rows of a search that names no k. max_*_expansions: terms that a prefix or fuzzy clause may become.
    max_fuzzy_distance: the largest edit distance that a query may ask for. segments_per_level: segments that a level holds
    before they are merged."""

    default_limit: int = 1000
    max_prefix_expansions: int = 50
    max_fuzzy_expansions: int = 50
    max_fuzzy_distance: int = 2
    min_fuzzy_term_len: int = 3
    segments_per_level: int = 8

    def __post_init__(self):
        for f in fields(self):
            low, high = _RANGES[f.name]
            if not low <= getattr(self, f.name) <= high:
                raise QuillError(f"{f.name} must be between {low} and {high}")
