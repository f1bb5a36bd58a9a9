"""How an index is built."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class PerformancePriority(Enum):
    """Trades memory for speed while building; answers don't depend on it.

    It sets the piece that a long text is cut to before its positions are spread, and how suffixes are sorted: as whole
    strings (high speed, short texts only) or by prefix doubling, which needs a few numbers for each suffix.
    """

    HIGH_SPEED = "high_speed"
    BALANCED = "balanced"
    LOW_MEMORY = "low_memory"


CHUNKS = {PerformancePriority.HIGH_SPEED: 1 << 18, PerformancePriority.BALANCED: 1 << 16, PerformancePriority.LOW_MEMORY: 1 << 13}


@dataclass(frozen=True)
class IndexConfig:
    """lookup_table_depth is the length of the grams that occurrences are filed under; 0 chooses it by the alphabet.

    suffix_array_sampling_rate thins the suffix array of the inspection views (`suffixes.build_views`). index_width is
    the bits of a filed position, 32 or 64. chunk 0 leaves it to the priority. None of these changes answers.
    """

    suffix_array_sampling_rate: int = 4
    lookup_table_depth: int = 0
    priority: PerformancePriority = PerformancePriority.BALANCED
    chunk: int = 0
    index_width: int = 64

    def __post_init__(self):
        if self.suffix_array_sampling_rate < 1:
            raise ValueError("the sampling rate must be 1 or more")
        if self.lookup_table_depth < 0:
            raise ValueError("the lookup depth must not be negative")
        if self.index_width not in (32, 64):
            raise ValueError("positions have 32 or 64 bits")
        if not self.chunk:
            object.__setattr__(self, "chunk", CHUNKS[self.priority])

    def gram_length(self, searchable: int) -> int:
        """About 65,536 different grams by default: 8 for four symbols, 2 for bytes."""
        if self.lookup_table_depth:
            return self.lookup_table_depth
        k = 1
        while k < 8 and searchable ** (k + 1) <= 1 << 16:
            k += 1
        return max(2, k)
