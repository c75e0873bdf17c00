"""Row filters and the step-by-step filter report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_compound(df: DataFrame, all_of: Sequence[Column] = (), any_of: Sequence[Column] = ()) -> DataFrame:
    out = df
    for cond in all_of:
        out = out.filter(cond)
    return out.filter(reduce(lambda a, b: a | b, any_of)) if any_of else out


def filter_codes(df: DataFrame, col: str, codes: Iterable[object], keep: bool = True) -> DataFrame:
    inside = F.col(col).isin(list(codes))
    return df.filter(inside if keep else ~inside)


def filter_nulls(df: DataFrame, present: Iterable[str] = (), absent: Iterable[str] = ()) -> DataFrame:
    tests = [F.col(c).isNotNull() for c in present] + [F.col(c).isNull() for c in absent]
    return filter_compound(df, tests)


def filter_between(df: DataFrame, col: Column, low: object, high: object) -> DataFrame:
    return df.filter(col.between(low, high))


def filter_like(df: DataFrame, col: str, patterns: Iterable[str]) -> DataFrame:
    return filter_compound(df, any_of=[F.col(col).like(p) for p in patterns])


def filter_asof(df: DataFrame, col: str, snapshot: Column) -> DataFrame:
    """Rows dated on or before the snapshot. A plain date column is compared uncast, so that the
    bound reaches the scan."""
    day = F.col(col) if dict(df.dtypes)[col] == "date" else F.to_date(F.col(col))
    return df.filter(day <= snapshot)


def filter_window_pair(df: DataFrame, first: str, last: str, cutoff: Column) -> DataFrame:
    """Both dates known and not after the cut-off."""
    return df.filter((F.col(last) <= cutoff) & (F.col(first) <= cutoff))


def waterfall(
    df: DataFrame,
    steps: Sequence[tuple[str, Column]],
    key: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows (or distinct keys) left and removed after each condition, applied in order, per group.

    One pass: each row gets the number of conditions it passes in a row; per key the deepest row
    counts. The rest is a sum per step, so no row is repeated per step.
    """
    depth = F.lit(len(steps))
    for i in range(len(steps) - 1, -1, -1):
        depth = F.when(steps[i][1], depth).otherwise(F.lit(i))
    rows = df.select(depth.alias("_depth"), *by, *([key] if key else []))
    if key:
        rows = rows.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max("_depth").alias("_depth"))
    sums = rows.groupBy(*by).agg(
        *[
            F.sum((F.col("_depth") >= i).cast("long")).alias(f"_at_{i}")
            for i in range(len(steps) + 1)
        ]
    )
    at = [F.coalesce(F.col(f"_at_{i}"), F.lit(0).cast("long")) for i in range(len(steps) + 1)]
    report = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("condition"),
                (at[i] - at[i + 1]).alias("removed"),
                at[i + 1].alias("remaining"),
            )
            for i, (name, _) in enumerate(steps)
        ]
    )
    return sums.select(*by, F.inline(report))
