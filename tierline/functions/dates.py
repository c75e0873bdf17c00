"""Calendar expressions: month ends, month offsets, elapsed time, quarter labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(day: Column, back: int = 0) -> Column:
    """Last day of the month `back` + 1 months before the month of `day`."""
    return F.last_day(F.add_months(day, -1 - back))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_offset(day: Column, snapshot: Column) -> Column:
    """Months from the snapshot month to the month of `day`, minus one: the snapshot month is -1."""
    return (month_index(day) - month_index(snapshot) - 1).cast("int")


def months_apart(later: Column, earlier: Column) -> Column:
    return F.months_between(later, earlier)


def whole_months(later: Column, earlier: Column) -> Column:
    """Complete months, cut towards zero."""
    return F.months_between(later, earlier).cast("int")


def elapsed(later: Column, earlier: Column, unit: float = 1) -> Column:
    """Days divided by `unit` (7 weeks, 30 months, 365.25 years)."""
    return F.datediff(later, earlier) / F.lit(unit)


def previous_due(mode: Column, paid_to: Column) -> Column:
    """Due date before `paid_to` for a payment every `mode` months; NULL for other modes."""
    return F.when(mode.isin(1, 3, 6, 12), F.add_months(paid_to, -mode))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_index(day: Column, months_back: int = 0) -> Column:
    """Running number of the quarter `months_back` months before the month of `day`."""
    return F.floor((month_index(day) - (1 + months_back)) / F.lit(3)).cast("int")


def lagged_quarter(day: Column) -> Column:
    """Label of the financial quarter two quarters earlier, e.g. 2001-05-10 -> '2000 Q4'."""
    back = F.add_months(day, -6)
    return F.concat(F.year(back).cast("string"), F.lit(" Q"), F.quarter(back).cast("string"))


def parse_event_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(text, fmt)


def previous_month_end(day: Column) -> Column:
    return F.last_day(F.add_months(day, -1))
