"""Fixed-English labels and sentence pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " · "


def number_text(x: Column) -> Column:
    """A rounded number as text, whole values without a decimal part."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def joined(*parts: Column) -> Column:
    """Non-null parts joined by a middle dot; null when there are none."""
    return F.nullif(F.concat_ws(SEPARATOR, *parts), F.lit(""))


def lines(*parts: Column) -> Column:
    """Array of the non-null sentences."""
    return F.filter(F.array(*parts), lambda s: s.isNotNull())


def plural(n: Column, word: str) -> Column:
    return F.concat(F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def day_short(day: Column) -> Column:
    """"7 Jan"."""
    return F.date_format(day, "d MMM")


def weekday_day(ts: Column) -> Column:
    """"Mon 7"."""
    return F.date_format(ts, "EEE d")


def weekday_clock(ts: Column) -> Column:
    """"Mon 09:05"."""
    return F.date_format(ts, "EEE HH:mm")


def hour_label(ts: Column) -> Column:
    """"06:00"."""
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))


def axis_day(day: Column, long_range: bool = False) -> Column:
    """"Jan 7", or "Jan 7, 24" where the axis spans years."""
    return F.date_format(day, "MMM d, yy" if long_range else "MMM d")
