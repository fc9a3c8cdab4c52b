"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_date(d: Column | str, unit: str = "week", week_start: str = "sunday") -> Column:
    """First day of the unit that holds `d`. Weeks start on Sunday by default."""
    d = F.to_date(_c(d))
    if unit == "day":
        return d
    if unit == "week" and week_start == "sunday":
        return F.date_sub(F.to_date(F.date_trunc("week", F.date_add(d, 1))), 1)
    if unit in {"week", "month", "quarter", "year"}:
        return F.to_date(F.date_trunc(unit, d))
    raise ValueError(f"unknown unit {unit!r}")


# Season names, December first.
SEASONS = ["December-February", "March-May", "June-August", "September-November"]


def season(d: Column | str) -> Column:
    """Meteorological season of a date."""
    index = F.floor((F.month(_c(d)) % 12) / 3).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), index + 1)


def conception_date(birth: Column | str, weeks: Column | str) -> Column:
    """Birth date minus completed gestational weeks."""
    return F.date_sub(F.to_date(_c(birth)), (_c(weeks) * 7).cast("int"))


def iso(d: Column | str) -> Column:
    """A date as yyyy-MM-dd text."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def add_units(d: Column | str, n: int, unit: str) -> Column:
    """A date moved by whole units."""
    d = F.to_date(_c(d))
    if unit == "day":
        return F.date_add(d, n)
    if unit == "week":
        return F.date_add(d, 7 * n)
    if unit == "month":
        return F.add_months(d, n)
    if unit == "year":
        return F.add_months(d, 12 * n)
    raise ValueError(f"unknown unit {unit!r}")


def elapsed(a: Column | str, b: Column | str, unit: str = "day") -> Column:
    """Whole units from `a` to `b`."""
    a, b = F.to_date(_c(a)), F.to_date(_c(b))
    if unit == "day":
        return F.datediff(b, a).cast("long")
    if unit == "week":
        return F.floor(F.datediff(b, a) / 7).cast("long")
    if unit == "month":
        return F.floor(F.months_between(b, a)).cast("long")
    if unit == "year":
        return F.floor(F.months_between(b, a) / 12).cast("long")
    raise ValueError(f"unknown unit {unit!r}")
