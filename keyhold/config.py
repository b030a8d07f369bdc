"""Settings of a key window."""

from __future__ import annotations

from dataclasses import dataclass

POLICIES = ("first", "last", "refuse")


@dataclass(frozen=True)
class WindowConfig:
    """What a window keeps.

    span_us: a key is dropped when it is older than this, in microseconds (exactly this old: kept); None: no bound.
    capacity: most keys kept at a time; None: no bound.
    policy: ``first`` (a repeat leaves the key's age alone), ``last`` (a repeat refreshes it) or ``refuse`` (as
    ``first``, but a full window turns new keys away, where the others drop the oldest key).
    """

    span_us: int | None = None
    capacity: int | None = None
    policy: str = "first"

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if self.span_us is not None and self.span_us < 0:
            raise ValueError("span_us must not be negative")
        if self.capacity is not None and self.capacity < 1:
            raise ValueError("capacity must be at least 1")
