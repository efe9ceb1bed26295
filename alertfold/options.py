"""Options of compaction, with the same names and defaults users know."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Settings shared by batch and online compaction."""

    wait: int = 10  # seconds per tick
    accuracy: float = 0.4  # messages nearer than this are similar
    spread: float = 0.1  # how much nearer another head must be to take a member over
    max_messages: int = 50  # messages of one chat handled together
    min_approx: int = 5  # boxes up to this size are sent unchanged
    dont_approximate_multibyte: bool = False
    history_check_count: int = 20
    history_max_age_minutes: int = 60

    def __post_init__(self) -> None:
        if self.wait <= 0 or self.max_messages <= 0:
            raise ValueError("wait and max_messages must be positive")
        if not 0 < self.accuracy < 1:
            raise ValueError("accuracy must lie between 0 and 1")
        if self.spread < 0:
            raise ValueError("spread must not be negative")
