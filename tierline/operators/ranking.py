"""Latest and first rows per key, top lists, rare categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierline.operators.ordered import Order, sort_columns


def top_k_per_key(df: DataFrame, key: Sequence[str], order: Order, k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows of each key. The order must break ties.

    Spark cuts each map task's rows to `k` per key before the shuffle (WindowGroupLimit), so a hot
    key sends at most `k` rows per task.
    """
    place = rank or "_place"
    window = W.partitionBy(*key).orderBy(*sort_columns(order))
    out = df.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= k)
    return out if rank else out.drop(place)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    return top_k_per_key(df, key, order, 1)


def first_per_key(df: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    return top_k_per_key(df, key, order, 1)


def asof_rate(rates: DataFrame, typ: str, ccy: str, day: Column) -> DataFrame:
    """One row: the rate with the newest effective date not after `day`."""
    return rates.filter(
        (F.col("rate_typ") == typ) & (F.col("ccy") == ccy) & (F.col("fr_eff_dt") <= day)
    ).agg(F.max_by("xchng_rate", "fr_eff_dt").alias("ex_rate"))


def carry_latest(df: DataFrame, key: str, day: str, amount: str, day_name: str, amount_name: str) -> DataFrame:
    """Newest date of the key, and the amount of that date (the larger of two), on every row."""
    newest = df.groupBy(key).agg(F.max(F.struct(day, amount)).alias("_newest"))
    newest = newest.select(
        F.col(key).alias("_key"),
        F.col(f"_newest.{day}").alias(day_name),
        F.col(f"_newest.{amount}").alias(amount_name),
    )
    return df.join(newest, df[key] == newest["_key"]).drop("_key")


def first_and_repeat(df: DataFrame, user: str, ts: str, until: Column, first: str, last_repeat: str) -> DataFrame:
    """First event of each user, and the last of the later ones not after `until`.

    An event at or before `until` is a repeat unless it is the only one, so counts and extremes
    answer this without numbering the events of a user.
    """
    early = F.when(F.col(ts) <= until, F.col(ts))
    return df.groupBy(user).agg(
        F.min(ts).alias(first),
        F.when(F.count(early) >= 2, F.max(early)).alias(last_repeat),
    )


def first_non_null(cols: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])


def top_n(df: DataFrame, order: Order, n: int) -> DataFrame:
    return df.orderBy(*sort_columns(order)).limit(n)


def top_categories(df: DataFrame, col: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the `n` most frequent values (equal counts: the smaller value); the rest becomes `other`.

    The list has at most `n` rows, so it is broadcast.
    """
    kept = (
        df.groupBy(col)
        .agg(F.count("*").alias("_n"))
        .filter(F.col(col).isNotNull())
        .orderBy(F.desc("_n"), F.asc(col))
        .limit(n)
        .select(F.col(col).alias("_kept"))
    )
    out = df.join(F.broadcast(kept), F.col(col) == F.col("_kept"), "left")
    return out.withColumn(f"{col}_grouped", F.coalesce(F.col("_kept").cast("string"), F.lit(other))).drop("_kept")


def rare_to_other(df: DataFrame, col: str, min_count: int, other: str = "Others") -> DataFrame:
    """Values seen fewer than `min_count` times become `other`."""
    rare = (
        df.groupBy(col)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") < min_count)
        .select(F.col(col).alias("_rare"))
    )
    out = df.join(rare, F.col(col) == F.col("_rare"), "left")
    return out.withColumn(
        f"{col}_grouped", F.when(F.col("_rare").isNotNull(), F.lit(other)).otherwise(F.col(col).cast("string"))
    ).drop("_rare")
