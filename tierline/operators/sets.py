"""Set operations and duplicate handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_scores(frames: Sequence[tuple[DataFrame, Sequence[str]]], key: str, name: str) -> DataFrame:
    """Stack score tables, each reduced to its key and the smallest of its score columns."""
    parts = [
        df.select(key, F.least(*[F.col(c) for c in cols]).alias(name)) for df, cols in frames
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Distinct rows, or the distinct combinations of `subset`."""
    return df.select(*subset).distinct() if subset else df.distinct()


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def duplicate_audit(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: number of rows, of distinct keys, and of keys that repeat."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
    )
