"""Fading, weighting and counting transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.expressions import compile_numeric

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 365 * 86400}


def duration_seconds(text: str) -> float:
    """``90d``, ``1.5h``, ... in seconds; a year has 365 days."""
    import re

    found = re.fullmatch(r"(\d+(?:\.\d+)?)([smhdwy])", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return float(found[1]) * SECONDS[found[2]]


def micros(ts: Column) -> Column:
    """Microseconds of a time, with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, now: Column, clamp: bool) -> Column:
    """Seconds from ``ts`` to ``now``; negative for the future unless clamped."""
    age = (micros(now) - micros(ts)) / 1e6
    return F.greatest(age, F.lit(0.0)) if clamp else age


def fade(ts: Column, now: Column, half_life: float, clamp: bool = False) -> Column:
    """``2 ** (-age / half_life)``; 1 without a half-life."""
    return F.pow(F.lit(2.0), -age_seconds(ts, now, clamp) / half_life) if half_life > 0 else F.lit(1.0)


def transform(value: Column, how: str | None) -> Column:
    """identity, log1p and sqrt of the non-negative part, clamp to [0, 1], or an
    expression in ``v``."""
    if how in (None, "identity"):
        return value
    if how == "log1p":
        return F.log1p(F.greatest(value, F.lit(0.0)))
    if how == "sqrt":
        return F.sqrt(F.greatest(value, F.lit(0.0)))
    if how == "clamp":
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return compile_numeric(how, "v")(value)


def edge_weight(value: Column, weight: float, has_value: bool, how: str | None = None) -> Column:
    """An event's weight: the declared one, times the transformed value where a value is
    declared; NULL (the event is skipped) where that value is missing."""
    return F.lit(weight) * transform(value, how) if has_value else F.lit(weight)
