"""Turning values into labels: interval bands, first-match rules, code maps, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    (cond, value), *rest = rules
    start = F.when(cond, F.lit(value))
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), rest, start)
    return chain.otherwise(F.lit(default))


def band(
    col: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True
) -> Column:
    """Right-closed intervals between `edges`; outside all of them, and for NULL, NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    rules = []
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        above = (col >= F.lit(low)) if i == 0 and include_lowest else (col > F.lit(low))
        rules.append((above if high == INF else above & (col <= F.lit(high)), label))
    return first_match(rules)


def map_codes(col: Column, mapping: Mapping[object, object], default: object = None) -> Column:
    return first_match([(col == F.lit(k), v) for k, v in mapping.items()], default)


def flag(cond: Column | str) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    if isinstance(cond, str):
        return F.expr(f"case when {cond} then 1 else 0 end")
    return F.when(cond, 1).otherwise(0)


def cap(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Floor and cap; NULL stays NULL (`least`/`greatest` alone would skip it)."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


# Insured-person relation codes and their labels.
RELATION_LABELS = {
    0: "Others",
    1: "Self",
    2: "Spouse",
    3: "Child",
    4: "Others",
    5: "Others",
    10: "Others",
    31: "Others",
    51: "Parent",
    52: "Others",
}


def relation_label(code: Column) -> Column:
    return map_codes(code.cast("int"), RELATION_LABELS)


def infer_relation(same: Column, gap: Column, gender_1: Column, gender_2: Column) -> Column:
    """Relation of an insured person to the owner from the age gap (owner minus insured)."""
    return first_match(
        [
            ((same == 1) | gap.isNull(), "self"),
            (gap.between(18, 40), "child"),
            (gap > 40, "others"),
            (gap < -17, "parent"),
            (gender_1 != gender_2, "spouse"),
        ],
        "others",
    )


def argmax_columns(names: Sequence[str]) -> Column:
    """Name of the column with the largest value of the row; of equal ones the first."""
    top = F.greatest(*[F.col(n) for n in names])
    return first_match([(F.col(n) == top, n) for n in names])


# Sales tiers from best to unranked, and their yearly premium benchmarks.
TIER_RANK = {
    "TOT": 1,
    "COT": 2,
    "MDRT": 3,
    "Platinum": 4,
    "Gold": 5,
    "Silver": 6,
    "Unranked": 7,
}
TIER_BENCHMARK = {
    "Silver": 60000.0,
    "Gold": 360000.0,
    "Platinum": 600000.0,
    "MDRT": 933604.6,
    "COT": 2800813.8,
    "TOT": 5601627.6,
}


def next_tier(tier: Column) -> Column:
    """One step up; the best tier stays."""
    names = list(TIER_RANK)
    return map_codes(tier, {n: names[max(i - 1, 0)] for i, n in enumerate(names)})
