"""Ranges of settings as data. Messages follow from the range and the value."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Range:
    """Finite numbers from ``low`` to ``high``; ``above`` leaves ``low`` itself out and ``whole`` asks for an int."""

    low: float = -math.inf
    high: float = math.inf
    above: bool = False
    whole: bool = False

    def __str__(self) -> str:
        kind = "whole numbers" if self.whole else "finite numbers"
        return f"{kind} in {'(' if self.above else '['}{self.low:g}, {self.high:g}{']' if math.isfinite(self.high) else ')'}"

    def __contains__(self, value) -> bool:
        if isinstance(value, bool) or not isinstance(value, int if self.whole else (int, float)):
            return False
        return math.isfinite(value) and self.low <= value <= self.high and not (self.above and value == self.low)


def check_ranges(owner: object, ranges: dict[str, Range]) -> None:
    """Raise for the first setting of ``owner`` outside its range; None passes, since it switches a setting off."""
    for name, allowed in ranges.items():
        value = getattr(owner, name)
        if value is not None and value not in allowed:
            raise ValueError(f"setting {name}: {value!r} is not among the {allowed}")


def check_choice(name: str, value, choices) -> None:
    if value not in choices:
        raise ValueError(f"setting {name}: {value!r} is not among {sorted(choices)}")
