"""Aggregations: trailing windows, conditional and distinct counts, profiles, cross-tabs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.bands import first_match
from tierline.functions.money import mean, mean_text, total_or_zero, total_text
from tierline.operators.ordered import Order, percentiles
from tierline.operators.ranking import top_k_per_key


def trailing_windows(offset: str, year: str, current_year: int) -> dict[str, str]:
    """Conditions on a month offset (snapshot month -1): months back, last year, year to date, all.

    `offset` and `year` are columns or expression text; so are the conditions.
    """
    return {
        "last_yr": f"{year} = {current_year - 1}",
        "last_mth": f"{offset} = -1",
        "last_3m": f"{offset} between -3 and -1",
        "last_6m": f"{offset} between -6 and -1",
        "last_9m": f"{offset} between -9 and -1",
        "last_12m": f"{offset} between -12 and -1",
        "ytd": f"{year} = {current_year} and {offset} <= -1",
        "total": f"{offset} <= -1",
    }


def trailing_sums(
    df: DataFrame,
    key: Sequence[str],
    period: Sequence[str],
    windows: Mapping[str, str],
    values: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """Sum of each value (with its decimals) over each window.

    `period` names the columns the windows are stated in. Rows are summed per key and period first:
    that takes one sum per value instead of one per value and window, shuffles one row per key and
    month, and splits a hot key over its months.
    """
    parts = df.groupBy(*key, *period).agg(
        *[F.expr(f"sum(cast({value} as decimal(18,{scale})))").alias(f"_{name}") for name, (value, scale) in values.items()]
    )
    return parts.groupBy(*key).agg(
        *[
            F.expr(f"coalesce(cast(sum(case when {cond} then _{name} end) as double), 0.0d)").alias(f"{window}_{name}")
            for name in values
            for window, cond in windows.items()
        ]
    )


def trailing_distinct(
    df: DataFrame,
    key: str,
    windows: Mapping[str, str],
    families: Mapping[str, Mapping[str, str]],
    single: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Distinct items per key over each window, for several items and conditions.

    `families` maps an item to {name: condition} and gives `<window>_<name>` for every window;
    `single` adds columns of their own condition. Counting each condition distinctly would repeat
    every row once per condition. Instead the conditions of a row are set as bits, the bits of equal
    (key, item) are OR-ed - before and after the one shuffle, so a hot key arrives as one row per
    item and task - and then counted per key.
    """
    single = single or {}
    seen = " | ".join(f"case when {cond} then {1 << i}L else 0L end" for i, cond in enumerate(windows.values()))
    if len(windows) > 63:
        raise ValueError("more windows than a long has bits")
    entries, outputs = [], []
    for item in dict.fromkeys([*families, *single]):
        # Each family takes a bit per window, each single condition one; an item fills one long after the other.
        wanted = [(f"case when {cond} then shiftleft(_seen, {{}}) else 0L end", [f"{w}_{name}" for w in windows])
                  for name, cond in families.get(item, {}).items()]
        wanted += [(f"case when {cond} then shiftleft(1L, {{}}) else 0L end", [name]) for name, cond in single.get(item, {}).items()]
        longs: list[list[str]] = []
        used = 64
        for term, names in wanted:
            if used + len(names) > 63:
                longs.append([])
                used = 0
            longs[-1].append(term.format(used))
            outputs.extend((len(entries) + len(longs) - 1, used + i, name) for i, name in enumerate(names))
            used += len(names)
        entries += [
            f"named_struct('family', {len(entries) + i}, 'item', cast({item} as string), 'bits', {' | '.join(terms)})"
            for i, terms in enumerate(longs)
        ]
    widest = max(i for _, i, _ in outputs) + 1
    items = (
        df.withColumn("_seen", F.expr(seen))
        .selectExpr(key, f"inline(array({', '.join(entries)}))")
        .filter("item is not null and bits <> 0")
        .groupBy(key, "family", "item")
        .agg(F.bit_or("bits").alias("bits"))
    )
    # One row per key and family, then the families side by side.
    counted = items.groupBy(key, "family").agg(
        *[F.expr(f"sum(shiftright(bits, {i}) & 1L)").alias(f"_{i}") for i in range(widest)]
    )
    return counted.groupBy(key).agg(
        *[F.expr(f"coalesce(max(case when family = {number} then _{i} end), 0L)").alias(out) for number, i, out in outputs]
    )


def distinct_by_flag(df: DataFrame, key: str, item: str, flags: Mapping[str, Column]) -> DataFrame:
    """Distinct items per key for each flag: flags are merged per item first, then summed."""
    per_item = (
        df.filter(F.col(item).isNotNull())
        .groupBy(key, item)
        .agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])
    )
    return per_item.groupBy(key).agg(*[F.sum(n).alias(n) for n in flags])


def count_by_category(df: DataFrame, key: str, col: str, names: Mapping[object, str]) -> DataFrame:
    """One count column per category."""
    return df.groupBy(key).agg(
        *[F.sum(F.when(F.col(col) == v, 1).otherwise(0)).alias(n) for v, n in names.items()]
    )


def any_flag(df: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])


def count_present(df: DataFrame, key: str, cols: Sequence[str], name: str) -> DataFrame:
    """Non-NULL values across several columns, summed per key; keys with none are left out."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return df.groupBy(key).agg(F.sum(filled).alias(name)).filter(F.col(name) > 0)


def pivot_first_n(
    df: DataFrame, key: str, order: Order, n: int, cols: Sequence[str], types: Mapping[str, str] | None = None
) -> DataFrame:
    """The first `n` rows of each key side by side: `<col>_1`, `<col>_2`, ..."""
    placed = top_k_per_key(df, [key], order, n, rank="_place")
    casts = types or {}
    aggs = []
    for i in range(1, n + 1):
        for c in cols:
            value = F.max(F.when(F.col("_place") == i, F.col(c)))
            aggs.append((value.cast(casts[c]) if c in casts else value).alias(f"{c}_{i}"))
    return placed.groupBy(key).agg(*aggs)


def quantile_cutoffs(df: DataFrame, cols: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact percentile cut-offs of several columns, one row per column."""
    out = None
    for c in cols:
        row = percentiles(df, [], c, shares).select(F.lit(c).alias("measure"), *shares)
        out = row if out is None else out.unionByName(row)
    return out


# A profile measure: (output name, function, column, condition text or None, decimals).
Measure = tuple[str, str, str, str | None, int]


def _measure(spec: Measure) -> Column:
    name, fn, col, cond, scale = spec
    value = col if cond is None else f"case when {cond} then {col} end"
    text = {
        "count": f"count({value})",
        "sum": f"coalesce({total_text(value, scale)}, 0.0d)",
        "mean": mean_text(value, scale),
        "min": f"min({value})",
        "max": f"max({value})",
        "distinct": f"count(distinct {value})",
    }[fn]
    return F.expr(text).alias(name)


def profile(df: DataFrame, by: Sequence[str], spec: Sequence[Measure]) -> DataFrame:
    """All measures of a spec list per group, in one grouping. A frame with one row per person
    counts persons with `count`; `distinct` is for frames with several rows per person."""
    return df.groupBy(*by).agg(*[_measure(s) for s in spec])


def profile_total(df: DataFrame, spec: Sequence[Measure]) -> DataFrame:
    return df.agg(*[_measure(s) for s in spec])


def crosstab_counts(df: DataFrame, dims: Sequence[str], name: str = "n", item: str | None = None) -> DataFrame:
    """Rows, or distinct items, per combination of dimensions."""
    if item is None:
        return df.groupBy(*dims).agg(F.count("*").alias(name))
    return df.select(*dims, item).distinct().groupBy(*dims).agg(F.count(item).alias(name))


def assign_segment(
    df: DataFrame, cols: Sequence[str], shares: Sequence[float], names: Sequence[str], segment: str = "segment"
) -> DataFrame:
    """Segment by quantile cut-offs: the first share any of the columns reaches, else the last name.

    `shares` run from the highest down; `names` has one more entry.
    """
    labels = [f"q{i}" for i in range(len(shares))]
    cuts = quantile_cutoffs(df, cols, dict(zip(labels, shares)))
    rules = []
    for label, name in zip(labels, names):
        reached = None
        for col in cols:
            cut = cuts.filter(F.col("measure") == col).select(label).scalar()
            test = F.col(col) >= cut
            reached = test if reached is None else reached | test
        rules.append((reached, name))
    return df.withColumn(segment, first_match(rules, names[-1]))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col(col).asc_nulls_last())


def collect_per_key(df: DataFrame, key: str, order: Order, value: str, k: int, name: str) -> DataFrame:
    """The best `k` values of each key in order, joined to one text; `k` bounds the list."""
    placed = top_k_per_key(df, [key], order, k, rank="_place")
    listed = F.array_sort(F.collect_list(F.struct("_place", F.col(value).cast("string").alias("v"))))
    return placed.groupBy(key).agg(F.array_join(F.transform(listed, lambda e: e["v"]), ",").alias(name))


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, min and max of numeric columns, one row per column, in one pass."""
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("measure"),
                F.count(c).alias("n"),
                mean(F.col(c)).alias("mean_value"),
                F.min(F.col(c).cast("double")).alias("min_value"),
                F.max(F.col(c).cast("double")).alias("max_value"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
            ).alias(c)
            for c in cols
        ]
    )
    return one.select(F.inline(F.array(*[F.col(c) for c in cols])))


def count_related(df: DataFrame, links: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """Distinct related items per key attached to the keys that have any."""
    per_key = links.select(key, item).distinct().groupBy(key).agg(F.count(item).alias(name))
    return df.join(per_key, key)


def composition(df: DataFrame, label: Column, name: str) -> DataFrame:
    """Value counts of a derived label."""
    return df.select(label.alias(name)).groupBy(name).agg(F.count("*").alias("n"))
