"""Run parameters of a yearly build, in place of a properties file."""

from __future__ import annotations

from dataclasses import dataclass

FIRST_YEAR = 1996


@dataclass(frozen=True)
class Params:
    """Defaults are the published settings; ``year`` is the only required one."""

    year: int
    look_back: int = 4
    max_level: int = 3
    sample_size: int = 32_000
    dim: int = 200
    min_count: int = 5
    window: int = 8
    epochs: int = 100
    public_top: int | None = None
    top_fraction: float = 0.02
    threshold: float = 0.24
    top_percent: float = 15.0
    min_words: int = 100

    def __post_init__(self):
        if self.year < FIRST_YEAR:
            raise ValueError(f"year must be {FIRST_YEAR} or later, got {self.year}")
        if not 0 <= self.top_fraction <= 1:
            raise ValueError("top_fraction must lie between 0 and 1")
        if self.top_percent < 0 or self.min_words < 0 or self.sample_size < 0:
            raise ValueError("top_percent, min_words and sample_size must not be negative")

    @property
    def first_year(self) -> int:
        return self.year - self.look_back
