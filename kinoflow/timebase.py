"""Rational timebases: exact integer arithmetic on presentation timestamps and nanoseconds."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000_000
LIMIT = (1 << 63) - 1


@dataclass(frozen=True)
class Timebase:
    """A tick lasts num/den seconds."""

    num: int = 1
    den: int = 1000

    def __post_init__(self):
        if self.den <= 0 or self.num < 0:
            raise ValueError("a timebase needs a positive denominator")


def nanos(ticks: int, tb: Timebase) -> int:
    """Whole nanoseconds of a number of ticks, rounded down."""
    return ticks * tb.num * SECOND // tb.den


def lasts(ticks: int, tb: Timebase, least_ns: int) -> bool:
    """Whether a non-negative number of ticks is at least so long; a negative one never is."""
    return ticks >= 0 and ticks * tb.num * SECOND >= least_ns * tb.den


def least_ticks(least_ns: int, tb: Timebase) -> int | None:
    """The least number of ticks that lasts so long; None if none does."""
    if least_ns <= 0:
        return 0
    return -(-least_ns * tb.den // (tb.num * SECOND)) if tb.num else None


def ticks_of(ns: int, tb: Timebase) -> int:
    """The nearest number of ticks, halves up."""
    if tb.num == 0:
        raise ValueError("a timebase of zero has no ticks")
    unit = tb.num * SECOND
    return (2 * ns * tb.den + unit) // (2 * unit)


def rescale_ceil(pts: int, old: Timebase, new: Timebase) -> int | None:
    """The first tick of ``new`` at or after a time; None where 64 bits don't hold it."""
    if new.num == 0:
        return None
    out = -((-pts * old.num * new.den) // (old.den * new.num))
    return out if -LIMIT - 1 <= out <= LIMIT else None


def compare(a: int, a_tb: Timebase, b: int, b_tb: Timebase) -> int:
    left, right = a * a_tb.num * b_tb.den, b * b_tb.num * a_tb.den
    return (left > right) - (left < right)


def frames_to_ns(frames: int, fps_num: int, fps_den: int = 1) -> int:
    """How long so many frames last, to the nearest nanosecond."""
    if fps_num <= 0:
        raise ValueError("a frame rate must be positive")
    return (2 * frames * fps_den * SECOND + fps_num) // (2 * fps_num)


def interpolate(start: int, end: int, share: float) -> int:
    return start + int((end - start) * share)
