"""Distributed order operators against window functions and brute force, with one hot key."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierline.operators import ordered as O

ORDER = [("v", "desc"), ("id", "asc")]


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small frames would be merged into one range; keep the ranges apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def numbers(spark, n, distinct, seed=1, nulls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = None if nulls and rnd.random() < 0.1 else float(rnd.randrange(distinct))
        # A third of all rows share one key.
        rows.append((i, 0 if rnd.random() < 0.34 else rnd.randrange(1, 6), v))
    return spark.createDataFrame(rows, "id long, k int, v double")


@pytest.mark.parametrize("n,buckets", [(1003, 10), (1000, 10), (7, 10), (1, 3), (0, 4), (500, 7)])
@pytest.mark.parametrize("distinct", [1, 5, 100000])
def test_ntile_equals_window(spark, n, buckets, distinct):
    df = numbers(spark, n, distinct)
    window = W.orderBy(*O.sort_columns(ORDER))
    want = {r["id"]: r["b"] for r in df.select("id", F.ntile(buckets).over(window).alias("b")).collect()}
    got = {r["id"]: r["b"] for r in O.ntile_global(df, buckets, ORDER, "b").collect()}
    assert got == want
    sizes = pd.Series(list(got.values()), dtype="int64").value_counts()
    assert n == 0 or sizes.max() - sizes.min() <= 1


def test_ntile_within_leaves_others_out(spark):
    df = numbers(spark, 200, 50)
    out = O.ntile_within(df, F.col("k") == 0, 4, ORDER)
    assert out.filter("k <> 0").count() == 0
    assert out.count() == df.filter("k = 0").count()


@pytest.mark.parametrize("fn", ["sum", "min", "max"])
def test_running_equals_window(spark, fn):
    df = numbers(spark, 900, 40, nulls=False)
    order = [("v", "asc"), ("id", "asc")]
    window = W.partitionBy("k").orderBy(*O.sort_columns(order)).rowsBetween(W.unboundedPreceding, 0)
    want = {r["id"]: r["x"] for r in df.select("id", getattr(F, fn)("v").over(window).alias("x")).collect()}
    got = {r["id"]: r["x"] for r in O.running(df, ["k"], order, "v", fn, "x").collect()}
    assert got == want


def test_a_hot_key_spans_ranges(spark):
    df = numbers(spark, 900, 40)
    ranged = O.in_ranges(df, [("k", "asc"), *ORDER])
    hot = ranged.filter("k = 0").select("_range").distinct().count()
    assert hot > 1
    assert ranged.count() == 900


def test_average_rank(spark):
    df = spark.createDataFrame([(v,) for v in [9.0, 5.0, 5.0, 3.0, 3.0, 3.0, 0.0, 0.0, None]], "v double")
    got = sorted((r["v"] is None, -(r["v"] or 0), r["rank"]) for r in O.average_rank(df, "v").collect())
    assert [g[2] for g in got] == [1, 2, 2, 5, 5, 5, 7, 7, None]


def test_average_rank_like_pandas(spark):
    df = numbers(spark, 300, 25, nulls=False)
    pdf = df.toPandas()
    want = dict(zip(pdf["id"], pdf["v"].rank(ascending=False).astype(int)))
    assert {r["id"]: r["rank"] for r in O.average_rank(df, "v").collect()} == want


@pytest.mark.parametrize("hot", [0.0, None])
def test_average_rank_with_a_hot_value(spark, hot):
    """Nine rows of ten share a value: they are ranked alike, and the join spreads them over all tasks."""
    rows = [(i, hot if i % 10 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, v double")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = O.average_rank(df, "v", "r").withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set(name, before)
    want = dict(zip(range(4000), pd.Series([v for _, v in rows], dtype="float").rank(ascending=False)))
    assert len(out) == 4000 and all(pd.isna(r) and pd.isna(want[i]) or r == int(want[i]) for i, r in zip(out["id"], out["r"]))
    tasks = out["task"].value_counts()
    assert len(tasks) > 1 and tasks.max() < 2 * tasks.mean()


def test_percentiles_equal_builtin(spark):
    df = numbers(spark, 800, 60)
    shares = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9}
    got = {r["k"]: [r[n] for n in shares] for r in O.percentiles(df, ["k"], "v", shares).collect()}
    exact = df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    assert got == {r["k"]: [r[n] for n in shares] for r in exact.collect()}


def test_bucket_ends():
    assert O.bucket_ends(10, 3) == [3, 6]
    assert O.bucket_ends(2, 5) == [0]
    assert O.bucket_ends(0, 5) == []
