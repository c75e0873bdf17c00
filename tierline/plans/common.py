"""Names and conditions several plans share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.operators.ranking import asof_rate

Frames = Mapping[str, DataFrame]

# Policy status codes by family.
NOT_SOLD = ["A", "N", "R"]
DROPPED_FROM_INCOME = ["A", "N", "R", "X"]
IN_FORCE = ["1", "2", "3", "5"]
ACTIVE = ["1", "2", "3", "5", "7"]
LAPSED = ["B"]
SURRENDERED = ["E"]
MATURED = ["F", "H", "D", "M", "T"]
NOT_TAKEN = ["A"]
TERMINATED = ["C", "L", "N", "R", "X"]
PAID_UP = ["4", "7", "9"]
# The later status families: a paid-up or waived policy is not in force.
IN_FORCE_LATER = ["1", "3"]
PAID_UP_LATER = ["2", "4", "5", "7", "9"]


def day(snapshot: str) -> Column:
    return F.to_date(F.lit(snapshot))


def sold() -> Column:
    return ~F.col("pol_stat_cd").isin(NOT_SOLD)


def exchange_rate(t: Frames, snapshot: str) -> Column:
    """Rate in force at the snapshot, as a scalar subquery."""
    return asof_rate(t["rate"], "U", "78", day(snapshot)).scalar()
