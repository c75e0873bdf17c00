"""Amounts: exact sums, ratios, currency, annualised and adjusted premium.

Sums of amounts go through fixed-point decimals: the result does not depend on the order in
which partitions arrive, so a rerun on another number of executors gives the same figures.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(col: Column, scale: int = 2) -> Column:
    return col.cast(f"decimal(18,{scale})")


def total_text(expr: str, scale: int = 2) -> str:
    return f"cast(sum(cast({expr} as decimal(18,{scale}))) as double)"


def mean_text(expr: str, scale: int = 2) -> str:
    return f"try_divide({total_text(expr, scale)}, cast(count({expr}) as double))"


# The functions below take a column or, where many are built at once, expression text: one text is
# one call into the JVM instead of one per function.


def total(col: Column | str, scale: int = 2) -> Column:
    """Order-independent sum, NULL for no rows."""
    if isinstance(col, str):
        return F.expr(total_text(col, scale))
    return F.sum(exact(col, scale)).cast("double")


def total_or_zero(col: Column | str, scale: int = 2) -> Column:
    if isinstance(col, str):
        return F.expr(f"coalesce({total_text(col, scale)}, 0.0d)")
    return F.coalesce(total(col, scale), F.lit(0.0))


def mean(col: Column | str, scale: int = 2) -> Column:
    if isinstance(col, str):
        return F.expr(mean_text(col, scale))
    return F.try_divide(total(col, scale), F.count(col).cast("double"))


def ratio_of_sums(a: Column, b: Column, scale: int = 2) -> Column:
    return F.try_divide(total(a, scale), total(b, scale))


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; `default` where the denominator is 0 or either side is NULL."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def money_convert(amount: Column, rate: Column, factor: float = 1.0) -> Column:
    """Amount in the other currency, rounded to cents."""
    return (
        (amount.cast("double") / rate.cast("double") * F.lit(float(factor)))
        .cast("decimal(18,2)")
        .cast("double")
    )


def annualise(premium: Column, mode: Column) -> Column:
    """Premium per year for a payment every `mode` months."""
    return premium * F.lit(12.0) / mode.cast("double")


def gap_to_target(target: Column, actual: Column) -> Column:
    return F.when(
        target.isNotNull(),
        F.greatest(target - F.coalesce(actual, F.lit(0.0)), F.lit(0.0)),
    )


def inflate(value: Column, years: Column, rate: float = 0.0298) -> Column:
    """Value grown by simple yearly inflation over the years held."""
    return value * (F.lit(1.0) + years * F.lit(rate))


# Days per instalment by payment mode in months.
INSTALMENT_DAYS = {1: 31, 3: 92, 6: 183}
FREE_LOOK_DAYS = 21
FULL_YEAR_DAYS = 365


def adjusted_ape(
    days: Column, mode: Column, premium: Column, ape: Column, single_premium: Column
) -> Column:
    """Annual premium counted for the days a policy was in force.

    In force (days NULL) or a full year: all of it. Ended in the free-look period: nothing. Ended
    within the year: the instalments that fell due. Single-premium plans count a tenth of the
    premium once past the free-look period and nothing while the end is unknown.
    """
    due = F.when(mode == 12, ape)
    for months, span in INSTALMENT_DAYS.items():
        due = due.when(mode == months, premium * (F.floor(days / F.lit(span)) + 1))
    regular = (
        F.when(days.isNull(), ape)
        .when(days <= FREE_LOOK_DAYS, F.lit(0.0))
        .when(days >= FULL_YEAR_DAYS, ape)
        .otherwise(due.otherwise(F.lit(0.0)))
    )
    single = F.when(days.isNull() | (days <= FREE_LOOK_DAYS), F.lit(0.0)).otherwise(
        premium * F.lit(0.1)
    )
    return F.coalesce(F.when(single_premium, single).otherwise(regular), F.lit(0.0))
