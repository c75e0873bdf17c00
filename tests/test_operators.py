"""Operators on small frames: edges, NULLs, skew, brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.operators import aggregates as A
from tierline.operators import filters as P
from tierline.operators import joins as J
from tierline.operators import ranking as R
from tierline.operators import sets as U
from tierline.operators import shape as H
from tierline.sources import scan, sink

c = F.col


def skewed(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [
        (i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(8)}", rnd.randrange(30), rnd.randrange(-15, 3), rnd.choice([2000, 2001]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, k string, item int, mth int, yr int")


def test_trailing_distinct_equals_count_distinct(spark):
    df = skewed(spark)
    windows = A.trailing_windows("mth", "yr", 2001)
    out = A.trailing_distinct(df, "k", windows, {"item": {"all": "true", "even": "id % 2 = 0"}}, {"item": {"big": "item > 20"}})
    want = df.groupBy("k").agg(
        *[F.expr(f"count(distinct case when {w} then item end)").alias(f"{n}_all") for n, w in windows.items()],
        *[F.expr(f"count(distinct case when id % 2 = 0 and ({w}) then item end)").alias(f"{n}_even") for n, w in windows.items()],
        F.expr("count(distinct case when item > 20 then item end)").alias("big"),
    )
    cols = sorted(want.columns)
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_windows_nest(spark):
    df = skewed(spark)
    windows = A.trailing_windows("mth", "yr", 2001)
    row = A.trailing_sums(df, ["k"], ["mth", "yr"], windows, {"x": ("item", 0)}).agg(
        *[F.sum(f"{n}_x").alias(n) for n in windows]
    ).first()
    assert row["last_mth"] <= row["last_3m"] <= row["last_6m"] <= row["last_9m"] <= row["last_12m"] <= row["total"]


@pytest.mark.parametrize("n_groups, n_windows, n_single", [(8, 8, 0), (10, 10, 5), (1, 63, 2), (0, 3, 100), (7, 9, 1)])
def test_more_conditions_than_a_long_has_bits(spark, n_groups, n_windows, n_single):
    df = skewed(spark)
    rows = [r.asDict() for r in df.select("k", "item", "id").collect()]
    windows = {f"w{i}": f"id % {i + 2} = 0" for i in range(n_windows)}
    groups = {f"g{i}": f"item > {i}" for i in range(n_groups)}
    flags = {f"s{i}": f"id % {i + 3} = 1" for i in range(n_single)}
    got = A.trailing_distinct(df, "k", windows, {"item": groups} if groups else {}, {"item": flags, "id": {"ids": "item > 2"}})
    tests = {f"w{j}_g{i}": (lambda r, i=i, j=j: r["item"] > i and r["id"] % (j + 2) == 0) for i in range(n_groups) for j in range(n_windows)}
    tests |= {f"s{i}": (lambda r, i=i: r["id"] % (i + 3) == 1) for i in range(n_single)}
    for row in got.collect():
        mine = [r for r in rows if r["k"] == row["k"] and r["item"] is not None]
        assert all(row[name] == len({r["item"] for r in mine if test(r)}) for name, test in tests.items())
        assert row["ids"] == len({r["id"] for r in mine if r["item"] > 2})


def test_single_conditions_share_the_long_of_a_family(spark):
    out = A.trailing_distinct(skewed(spark), "k", {f"w{i}": "true" for i in range(8)}, {"item": {"g": "true"}}, {"item": {"s": "item > 1"}})
    assert out._jdf.queryExecution().analyzed().toString().count("named_struct(family") == 1


def test_too_many_windows(spark):
    with pytest.raises(ValueError):
        A.trailing_distinct(skewed(spark), "k", {f"w{i}": "true" for i in range(64)}, {"item": {"g": "true"}})


def test_top_k_limits_before_the_shuffle(spark):
    df = skewed(spark)
    out = R.top_k_per_key(df, ["k"], [("item", "desc"), ("id", "asc")], 3)
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_waterfall_adds_up(spark):
    df = skewed(spark)
    steps = [("a", c("item") > 5), ("b", c("mth") < 0), ("n", F.lit(None).cast("boolean"))]
    rows = P.waterfall(df, steps).orderBy("step").collect()
    before = df.count()
    for r in rows:
        assert r["removed"] + r["remaining"] == before
        before = r["remaining"]
    assert rows[-1]["remaining"] == 0
    grouped = P.waterfall(df, steps, "item", ["k"])
    assert grouped.count() == 3 * df.select("k").distinct().count()


def test_waterfall_of_nothing(spark):
    rows = P.waterfall(skewed(spark).limit(0), [("a", c("item") > 5)]).collect()
    assert [(r["removed"], r["remaining"]) for r in rows] == [(0, 0)]


@pytest.mark.parametrize("low,high", [(0, 2), (-2, 0), (1, 1), (0, 11)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_equals_brute_force(spark, low, high, how):
    rnd = random.Random(5)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randrange(900))
    left = spark.createDataFrame([(i, rnd.choice([1, 1, 2]), day()) for i in range(120)], "i int, k int, d date")
    right = spark.createDataFrame([(i, rnd.choice([1, 1, 3]), day()) for i in range(60)], "j int, k int, e date")
    got = J.interval_join(left, right, ["k"], "d", "e", low, high, how).select("i", "j")
    other = right.withColumnRenamed("k", "k2")
    naive = left.join(
        other, (c("k") == c("k2")) & F.floor(F.months_between("d", "e")).between(low, high), how
    ).select("i", "j")
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, naive.collect()), key=key)


def test_first_and_repeat(spark):
    rows = [("a", 1), ("a", 5), ("a", 9), ("b", 4), ("c", 8), ("c", 9)]
    df = spark.createDataFrame(rows, "u string, t int")
    out = {r["u"]: (r["f"], r["l"]) for r in R.first_and_repeat(df, "u", "t", F.lit(6), "f", "l").collect()}
    assert out == {"a": (1, 5), "b": (4, None), "c": (8, None)}


def test_snapshot_fallback(spark):
    df = spark.createDataFrame([(1, dt.date(2001, 5, 31)), (2, dt.date(2001, 7, 31))], "i int, d date")
    pick = lambda frame, day: [r["i"] for r in scan.snapshot_or_latest(frame, "d", F.lit(day)).collect()]
    assert pick(df, dt.date(2001, 7, 31)) == [2]
    assert pick(df, dt.date(2001, 6, 30)) == [1]
    assert pick(df.filter("i = 2"), dt.date(2001, 6, 30)) == [2]
    assert pick(df.limit(0), dt.date(2001, 6, 30)) == []


def test_snapshot_scan_prunes(spark):
    path = sink.fresh_path(spark, "snap")
    df = spark.range(10).withColumn("d", (c("id") % 2).cast("int"))
    sink.write_partitions(df, path, ["d"])
    out = scan.scan_snapshot(spark, path, "d", 1)
    assert out.count() == 5
    assert "PartitionFilters: [isnotnull(d" in out._jdf.queryExecution().executedPlan().toString()


def test_unwrap_record(spark):
    df = spark.range(2).select(F.struct(F.lit(None).alias("v"), c("id").alias("i"), F.lit("x").alias("s")).alias("r"))
    out = scan.unwrap_record(df, "r")
    assert out.dtypes == [("v", "string"), ("i", "bigint"), ("s", "string")]


def test_load_tables_takes_the_first_path(spark):
    a, b = sink.fresh_path(spark, "a"), sink.fresh_path(spark, "b")
    spark.range(1).write.parquet(f"{b}/one")
    spark.range(2).write.parquet(f"{a}/two")
    spark.range(3).write.parquet(f"{b}/two")
    found = scan.load_tables(spark, [a, b], ["one", "two"])
    assert {k: v.count() for k, v in found.items()} == {"ONE": 1, "TWO": 2}
    assert spark.table("two").count() == 2
    with pytest.raises(FileNotFoundError):
        scan.load_tables(spark, [a], ["three"])


def test_write_partitions_replaces_only_what_it_brings(spark):
    path = sink.fresh_path(spark, "p")
    df = spark.range(6).withColumn("d", (c("id") % 3).cast("int"))
    sink.write_partitions(df, path, ["d"])
    sink.write_partitions(df.filter("d = 1").withColumn("id", c("id") + 100), path, ["d"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 101, 104]


def test_cast_family_and_fill(spark):
    df = spark.createDataFrame([(1, None, None)], "a int, b double, s string").withColumn("m", F.lit(1).cast("decimal(9,2)"))
    out = H.cast_family(H.cast_family(df, T.DecimalType, "double"), H.INTEGERS, "long")
    assert out.dtypes == [("a", "bigint"), ("b", "double"), ("s", "string"), ("m", "double")]
    assert tuple(H.fill_nulls(H.fill_nulls(df, 0), "N/A").select("b", "s").first()) == (0.0, "N/A")


def test_categories(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbccd"] + [(None,)], "x string")
    top = {r["x_grouped"]: r["count"] for r in R.top_categories(df, "x", 2).groupBy("x_grouped").count().collect()}
    assert top == {"a": 3, "b": 2, "Other": 4}
    rare = {r["x_grouped"]: r["count"] for r in R.rare_to_other(df, "x", 2).groupBy("x_grouped").count().collect()}
    assert rare == {"a": 3, "b": 2, "c": 2, "Others": 1, None: 1}


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert tuple(U.duplicate_audit(df, ["k"]).first()) == (3, 2, 1)
    assert U.duplicate_keys(df, ["k"]).collect()[0]["n_rows"] == 2


def test_map_by_key_is_deterministic(spark):
    lookup = spark.createDataFrame([(1, 9), (1, 3), (2, 5)], "k int, a int")
    out = J.map_by_key(spark.createDataFrame([(1,), (3,)], "k int"), lookup, "k", "a")
    assert {r["k"]: r["a"] for r in out.collect()} == {1: 3, 3: None}


def test_profile_counts_sum_to_population(spark):
    df = skewed(spark)
    spec = [("n", "count", "id", None, 0), ("s", "sum", "item", "mth < 0", 2), ("m", "mean", "item", None, 2)]
    assert A.profile(df, ["k"], spec).agg(F.sum("n")).first()[0] == df.count()
    assert A.profile_total(df, spec).first()["n"] == df.count()


def test_shared_dir_is_read_from_the_session(spark):
    assert sink.shared_dir(spark) == sink.shared_dir(spark)
