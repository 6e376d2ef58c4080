"""The parameters every job takes, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

LAST_COMMON_DAY = 28  # the last day of the month that every month has


@dataclass(frozen=True)
class TripWindow:
    """Hours of the day, days of the month and the K of top-K reports.

    With ``wrap`` a window that runs past midnight goes on at hour 0 (22 + 4 gives 22, 23, 0, 1);
    without it the window ends at 23. The days stop at 31; with ``common_days`` at 28, so that every
    month contributes the same days. ``zone`` names the zone whose hours and days are meant; times
    are then taken as UTC. Without it they are wall-clock time.
    """

    # The default parameters of the reports.
    hour_start: int = 11
    hour_count: int = 4
    day_start: int = 11
    day_count: int = 3
    top_k: int = 14
    wrap: bool = True
    common_days: bool = False
    zone: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.hour_start <= 23:
            raise ValueError(f"hour_start must be within 0..23, got {self.hour_start}")
        if not 1 <= self.hour_count <= 24:
            raise ValueError(f"hour_count must be within 1..24, got {self.hour_count}")
        if not 1 <= self.day_start <= 31:
            raise ValueError(f"day_start must be within 1..31, got {self.day_start}")
        if self.day_count < 1 or self.top_k < 1:
            raise ValueError("day_count and top_k must be positive")
        if not self.days:
            raise ValueError(f"no day from {self.day_start} on is in every month")

    @classmethod
    def from_id(cls, number: int) -> TripWindow:
        """The parameter set that belongs to an integer id. The three moduli."""
        return cls(hour_start=number % 24, day_start=number % 25 + 1, top_k=number % 11 + 10)

    @property
    def hours(self) -> list[int]:
        span = range(self.hour_start, self.hour_start + self.hour_count)
        if self.wrap:
            return [hour % 24 for hour in span]
        return [hour for hour in span if hour < 24]

    @property
    def days(self) -> list[int]:
        span = range(self.day_start, self.day_start + self.day_count)
        return [day for day in span if day <= (LAST_COMMON_DAY if self.common_days else 31)]
