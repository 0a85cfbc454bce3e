"""Named ranges, calendar periods and comparison presets.

Plain values for request parameters, and column forms for deriving windows from data.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range names, their lengths in days and the row caps of a request.
RANGE_DAYS = {"today": 1, "7d": 7, "30d": 30, "1y": 365}
RANGES = ("today", "7d", "30d", "1y", "all")
COMPARISON_RANGE_DAYS = {"7d": 7, "30d": 30, "1y": 365, "all": 36500}
RAW_ROW_CAPS = {"today": 200, "7d": 1200, "custom": 1500, "day": 400}
DAILY_ROW_CAP = 5000
RETENTION_DAYS = 90
ANCHOR_FORMS = {
    "day": r"\d{4}-\d{2}-\d{2}",
    "week": r"\d{4}-\d{2}-\d{2}",
    "month": r"\d{4}-\d{2}",
    "year": r"\d{4}",
}


def checked_window(start, end) -> tuple[str, str]:
    """Both bounds of a half-open window as text in UTC.

    A bound with an offset is converted; one without is in UTC already. Refuses a mix of
    both, and an empty or malformed window.
    """
    def parse(value):
        if isinstance(value, dt.datetime):
            return value
        if isinstance(value, dt.date):
            return dt.datetime.combine(value, dt.time())
        return dt.datetime.fromisoformat(str(value))

    lo, hi = parse(start), parse(end)
    if (lo.tzinfo is None) != (hi.tzinfo is None):
        raise ValueError(f"one bound has an offset, the other none: [{start}, {end})")
    if lo.tzinfo is not None:
        lo, hi = (x.astimezone(dt.timezone.utc).replace(tzinfo=None) for x in (lo, hi))
    if lo >= hi:
        raise ValueError(f"empty window: [{start}, {end})")
    return str(lo), str(hi)


def checked_range(name: str | None) -> str:
    return name if name in RANGES else "today"


def range_start(name: str, as_of: dt.datetime) -> dt.datetime:
    """Start of a rolling range; an unknown name means today (the last 24 hours)."""
    name = checked_range(name)
    if name == "all":
        return dt.datetime(1970, 1, 1)
    return as_of - dt.timedelta(days=RANGE_DAYS[name])


def comparison_range(name: str | None) -> str:
    return name if name in COMPARISON_RANGE_DAYS else "30d"


def comparison_range_start(name: str, as_of: dt.datetime) -> dt.datetime:
    return as_of - dt.timedelta(days=COMPARISON_RANGE_DAYS[comparison_range(name)])


@dataclass(frozen=True)
class Period:
    """Half-open run of calendar days with a label."""

    start: dt.date
    end: dt.date
    label: str


def _add_months(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def day_period(day: dt.date) -> Period:
    return Period(day, day + dt.timedelta(days=1), f"{day:%A} {day.day} {day:%B}")


def week_period(day: dt.date) -> Period:
    """Monday to Sunday."""
    start = day - dt.timedelta(days=day.weekday())
    return Period(start, start + dt.timedelta(days=7), f"Week of {start.day} {start:%B}")


def month_period(day: dt.date) -> Period:
    start = day.replace(day=1)
    return Period(start, _add_months(start, 1), f"{calendar.month_name[start.month]} {start.year}")


def year_period(day: dt.date) -> Period:
    return Period(dt.date(day.year, 1, 1), dt.date(day.year + 1, 1, 1), str(day.year))


_PERIODS = {"day": day_period, "week": week_period, "month": month_period, "year": year_period}


def anchor_is_valid(granularity: str, anchor: str) -> bool:
    return re.fullmatch(ANCHOR_FORMS[granularity], anchor) is not None


def anchored_period(granularity: str, anchor: str) -> Period:
    if not anchor_is_valid(granularity, anchor):
        raise ValueError(f"{anchor!r} does not name a {granularity}")
    full = {"month": f"{anchor}-01", "year": f"{anchor}-01-01"}.get(granularity, anchor)
    return _PERIODS[granularity](dt.date.fromisoformat(full))


def default_anchors(granularity: str, today: dt.date) -> tuple[str, str]:
    """The current period and the one before it."""
    if granularity in ("day", "week"):
        back = dt.timedelta(days=1 if granularity == "day" else 7)
        return today.isoformat(), (today - back).isoformat()
    if granularity == "month":
        return f"{today:%Y-%m}", f"{_add_months(today, -1):%Y-%m}"
    return str(today.year), str(today.year - 1)


def preset_periods(preset: str, today: dt.date) -> tuple[Period, Period]:
    """Month against last month, year against last year, month against last year's."""
    if preset == "yoy":
        return year_period(today), year_period(today.replace(year=today.year - 1, day=1))
    if preset == "momYoY":
        return month_period(today), month_period(_add_months(today, -12))
    return month_period(today), month_period(_add_months(today, -1))


# ---- column forms --------------------------------------------------------

def _day(col: Column) -> Column:
    return col.cast("date")


def week_start(day: Column) -> Column:
    return _day(F.date_trunc("WEEK", day))


def month_start(day: Column) -> Column:
    return _day(F.date_trunc("MONTH", day))


def year_start(day: Column) -> Column:
    return _day(F.date_trunc("YEAR", day))


def next_month(start: Column, months: int = 1) -> Column:
    return F.add_months(start, months)


def month_label(start: Column) -> Column:
    return F.date_format(start, "MMMM yyyy")


def week_label(start: Column) -> Column:
    return F.concat(F.lit("Week of "), F.date_format(start, "d MMMM"))


def day_label(day: Column) -> Column:
    return F.date_format(day, "EEEE d MMMM")


def day_of_period(day: Column, start: Column) -> Column:
    """1 for the first day."""
    return F.datediff(day, start) + 1
