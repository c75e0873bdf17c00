"""Exact results that depend on a total order, without bringing the order into one task.

A window without partitions, or with a key that holds a third of the rows, sorts in one task. Here
the rows are range-partitioned by the order (ties broken by a unique column, so even one repeated
value is spread), written once to the shared folder, and what one range must know of the ranges
before it - a count, a sum, a minimum - is carried over in a table with at most one row per range.
The written ranges stay the same when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.sources.sink import stage

# An order is a list of (column, "asc" | "desc"); NULLs come last in both directions.
Order = Sequence[tuple[str, str]]

_HOT_SHARE = 64  # a value with more than one row in so many is hot

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sort_columns(order: Order) -> list[Column]:
    return [
        F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last()
        for c, way in order
    ]


def in_ranges(df: DataFrame, order: Order) -> DataFrame:
    """Write `df` in total order. `_range` numbers the ordered ranges, `_at` the rows in each."""
    keys = sort_columns(order)
    row_id = F.monotonically_increasing_id()
    return stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", row_id.alias("_id"))
        .select(
            *df.columns,
            F.shiftright("_id", _ROW_BITS).cast("int").alias("_range"),
            F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at"),
        ),
        "ranges",
    )


def range_sizes(ranged: DataFrame) -> list[tuple[int, int]]:
    """(range, rows) in order; as many entries as there are ranges."""
    return sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())


def rows_at(ranged: DataFrame, sizes: Sequence[tuple[int, int]], positions: Sequence[int]) -> dict[int, dict]:
    """The rows at the given global positions (0-based) of a ranged frame: one row per position."""
    where: dict[tuple[int, int], int] = {}
    start = 0
    for number, size in sizes:
        where |= {(number, pos - start): pos for pos in positions if start <= pos < start + size}
        start += size
    if not where:
        return {}
    test = F.lit(False)
    for number, at in where:
        test = test | ((F.col("_range") == number) & (F.col("_at") == at))
    return {where[(r["_range"], r["_at"])]: r.asDict() for r in ranged.filter(test).collect()}


def bucket_ends(total: int, n: int) -> list[int]:
    """Positions of the last row of each ntile bucket but the last one that has rows."""
    small, larger = divmod(total, n)
    ends, seen = [], 0
    for i in range(n):
        seen += small + (1 if i < larger else 0)
        if seen >= total:
            break
        ends.append(seen - 1)
    return ends


def _comes_after(order: Order, row: Mapping[str, object]) -> Column:
    """True where the current row stands after `row` in the order."""
    out = F.lit(False)
    for name, way in reversed(order):
        here, mark = F.col(name), row[name]
        if mark is None:
            beyond, same = F.lit(False), here.isNull()
        else:
            past = here < F.lit(mark) if way == "desc" else here > F.lit(mark)
            beyond, same = here.isNull() | past, here.eqNullSafe(F.lit(mark))
        out = beyond | (same & out)
    return out


def ntile_global(df: DataFrame, n: int, order: Order, name: str = "bucket") -> DataFrame:
    """Exact `ntile(n)` over all rows. The order must end in a unique column.

    Only the order columns are sorted. The n - 1 rows at the bucket ends are then compared with
    each row of `df`, which is neither shuffled nor joined.
    """
    ranged = in_ranges(df.select(*[c for c, _ in order]), order)
    sizes = range_sizes(ranged)
    ends = bucket_ends(sum(size for _, size in sizes), n)
    found = rows_at(ranged, sizes, ends)
    bucket = F.lit(1)
    for pos in ends:
        bucket = bucket + F.when(_comes_after(order, found[pos]), 1).otherwise(0)
    return df.withColumn(name, bucket.cast("int"))


def ntile_multi(df: DataFrame, n: int, orders: Mapping[str, Order]) -> DataFrame:
    """Several ntiles on different measures; one output column per entry."""
    out = df
    for name, order in orders.items():
        out = ntile_global(out, n, order, name)
    return out


def ntile_within(df: DataFrame, inside: Column, n: int, order: Order, name: str = "bucket") -> DataFrame:
    """Ntile among the rows of one segment; other rows are left out."""
    return ntile_global(df.filter(inside), n, order, name)


_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
}


def running(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, fn: str, name: str
) -> DataFrame:
    """Running `fn` (sum, min, max) of `value` from the first row of the key to the current row.

    A key may span many ranges: each range is one window partition, and the result of the earlier
    ranges of the same key is carried in. A range continues at most one key of the range before
    it, so the carried table has at most one row per range and may be broadcast.
    """
    agg = getattr(F, fn)
    ranged = in_ranges(df, [(k, "asc") for k in keys] + list(order))
    per_range = ranged.groupBy(*keys, "_range").agg(agg(value).alias("_part"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_range.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_range").alias("_r"),
            agg("_part").over(earlier).alias("_before"),
            F.count("_range").over(earlier).alias("_n_before"),
        )
        .filter(F.col("_n_before") > 0)
        .drop("_n_before")
    )
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    so_far = W.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    here = agg(value).over(so_far)
    return (
        ranged.withColumn("_here", here)
        .join(F.broadcast(carried), match, "left")
        .select(*df.columns, _COMBINE[fn](F.col("_before"), F.col("_here")).alias(name))
    )


def running_min(df: DataFrame, keys: Sequence[str], order: Order, value: str, name: str) -> DataFrame:
    return running(df, keys, order, value, "min", name)


def asof_last(
    events: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, name: str
) -> DataFrame:
    """`events` with the last time of the marks of the same keys up to their own (null: none before).

    Marks and events are sorted together and the last mark is carried on as a running maximum, so that no event
    meets a mark in a join and a key with most of the rows is spread over ranges. At equal times the mark comes
    first. Null keys match each other; an event without a time has no mark.
    """
    both = marks.select(*keys, F.col(mark_at).alias("_when"), F.col(mark_at).alias("_mark"), F.lit(0).alias("_kind"), F.lit(None).alias("_event"))
    mine = events.select(
        *keys, F.col(at).alias("_when"), F.lit(None).alias("_mark"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_event")
    )
    known = both.filter(F.col("_when").isNotNull()).unionByName(mine)
    carried = running(known, keys, [("_when", "asc"), ("_kind", "asc")], "_mark", "max", "_last")
    last = F.when(F.col("_when").isNotNull(), F.col("_last")).alias(name)
    return carried.filter(F.col("_kind") == 1).select("_event.*", last)


def average_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Descending rank, ties sharing the mean of their places, cut to an integer; NULL for NULL.

    Works on one row per distinct value: places before it plus half of its own. Values that hold more than one
    row in _HOT_SHARE - fewer than _HOT_SHARE of them - are looked up in a small map; only the others meet their
    rank in a join, where no key can be hot. Rows that need no join are spread by a hash of the row.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    placed = running(counts, [], [(col, "desc")], "_n", "sum", "_upto")
    ranks = stage(
        placed.select(
            F.col(col).alias("_value"),
            F.floor(F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2)).cast("int").alias("_rank"),
            F.col("_n"),
        ),
        "ranks",
    )
    total = ranks.agg(F.sum("_n").alias("total")).scalar()
    hot = F.col("_n") * _HOT_SHARE > total
    entries = ranks.filter(hot).agg(F.map_from_entries(F.collect_list(F.struct("_value", "_rank"))).alias("hot")).scalar()
    others = ranks.filter(~hot).select("_value", "_rank", F.xxhash64("_value").alias("_spread"))
    plain = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    known = df.withColumn("_known", F.when(F.col(col).isNotNull(), F.element_at(entries, F.col(col))))
    key = F.when(F.col("_known").isNull(), F.col(col))
    keyed = known.select("*", key.alias("_key"), F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*plain)).alias("_s"))
    return keyed.join(others, (F.col("_key") == F.col("_value")) & (F.col("_s") == F.col("_spread")), "left").select(
        *df.columns, F.coalesce("_known", "_rank").alias(name)
    )


def percentiles(
    df: DataFrame, group: Sequence[str], col: str, shares: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated percentiles per group with mean, min, max and count, none of them rounded.

    Equal values are counted before anything is sorted, and the sort is spread over ranges, so a
    group with a third of all rows does not end up in one task.
    """
    known = df.filter(F.col(col).isNotNull())
    counts = known.groupBy(*group, col).agg(F.count("*").alias("_n"))
    placed = running(counts, group, [(col, "asc")], "_n", "sum", "_upto")
    totals = placed.groupBy(*group).agg(
        F.sum("_n").alias("n_rows"),
        F.min(col).alias("min_value"),
        F.max(col).alias("max_value"),
        (F.sum(F.col(col).cast("decimal(24,8)") * F.col("_n").cast("decimal(13,0)")).cast("double") / F.sum("_n")).alias("mean_value"),
    )
    if group:
        both = placed.join(totals.select(*group, "n_rows"), list(group))
    else:
        both = placed.withColumn("n_rows", totals.select("n_rows").scalar())
    aggs = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n_rows") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)
            aggs.append(F.max(F.when(covers, F.col(col))).alias(f"_{side}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    picked = both.groupBy(*group).agg(*aggs)
    values = [
        F.when(F.col(f"_part_{n}") == 0, F.col(f"_lo_{n}"))
        .otherwise((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}"))
        .alias(n)
        for n in shares
    ]
    if group:
        return picked.select(*group, *values).join(totals, list(group))
    one = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    return picked.select(*values, one.alias("_t")).select(*shares, "_t.*")
