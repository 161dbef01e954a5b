"""Operational keys: shift labels, operational dates and the time between observations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Shift names and first hours; a shift lasts to the next one's first hour, the last one over midnight.
SHIFTS = {
    "abc": (("A", 6), ("B", 14), ("C", 22)),
    "swapped": (("B", 6), ("A", 14), ("C", 22)),
    "day_night_06": (("Day", 6), ("Night", 18)),
    "day_night_07": (("Day", 7), ("Night", 19)),
    "day_night_08": (("Day", 8), ("Night", 20)),
    "day_night_10": (("Day", 10), ("Night", 22)),
}


def shift_label(ts: Column, scheme: str = "abc") -> Column:
    """The name of the shift that the hour of ``ts`` falls into; null for null."""
    shifts = SHIFTS[scheme]
    hour, out = F.hour(ts), F.lit(shifts[-1][0])
    for (name, start), (_, end) in zip(shifts, shifts[1:]):
        out = F.when((hour >= start) & (hour < end), F.lit(name)).otherwise(out)
    return F.when(ts.isNotNull(), out)


def op_date(ts: Column, family: str = "carry_back") -> Column:
    """The operational day of an observation.

    plus2h: the date two hours later. carry_back: before 06:00 the day before. late_back: from 22:00 on the day before.
    minus22h: the date 22 hours earlier.
    """
    if family == "plus2h":
        return F.to_date(ts + F.expr("INTERVAL 2 HOURS"))
    if family == "minus22h":
        return F.to_date(ts - F.expr("INTERVAL 22 HOURS"))
    if family == "carry_back":
        return F.date_sub(F.to_date(ts), F.when(F.hour(ts) < 6, 1).otherwise(0))
    if family == "late_back":
        return F.date_sub(F.to_date(ts), F.when(F.hour(ts) >= 22, 1).otherwise(0))
    raise ValueError(f"no such family of days: {family}")


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from ``a`` to ``b``, with fractions; for timestamps with and without zone."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def gap_seconds(by: list[str], ts: str = "ts", tiebreak: str | None = None, first: float = 0.0, cap: float | None = 300.0, ahead: bool = False) -> Column:
    """Seconds since the previous row of the entity (or to the next one), within 0 and ``cap``; ``first`` where there is none."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    w = Window.partitionBy(*by).orderBy(*order)
    gap = seconds_between(F.col(ts), F.lead(ts).over(w)) if ahead else seconds_between(F.lag(ts).over(w), F.col(ts))
    gap = F.greatest(F.coalesce(gap, F.lit(float(first))), F.lit(0.0))
    return gap if cap is None else F.least(gap, F.lit(float(cap)))


def has_prefix(x: Column, prefixes: list[str]) -> Column:
    """Whether a text begins with one of the prefixes, false for null: a filter that reaches the scan."""
    found = F.lit(False)
    for p in prefixes:
        found = found | x.startswith(p)
    return F.coalesce(found, F.lit(False))


def unique(names: list[str], there: list[str] | None = None) -> list[str]:
    """The names in order, each once, and only those that are in ``there``, if given: what to select when lists of columns are joined."""
    return [c for c in dict.fromkeys(names) if there is None or c in there]
