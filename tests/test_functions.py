"""Expressions on edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tierline.functions import bands, dates, money, text
from tierline.plans.agents import income_class
from tierline.plans.customers import vip_label

c = F.col


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(c("x"))).first()[0]


@pytest.mark.parametrize(
    "income,label",
    [(None, "G"), (0, "G"), (4999, "F"), (5000, "E"), (7500, "E"), (7501, "D"), (10000, "D"), (15000, "C"), (20000, "B"), (20001, "A")],
)
def test_income_class(spark, income, label):
    assert one(spark, income, "int", income_class).startswith(label)


@pytest.mark.parametrize("days", [None, 0, 21, 22, 91, 92, 364, 365])
@pytest.mark.parametrize("mode", [1, 3, 6, 12])
@pytest.mark.parametrize("single", [True, False])
def test_adjusted_ape(spark, days, mode, single):
    prem, ape = 100.0, 100.0 * 12 / mode
    if single:
        want = 0.0 if days is None or days <= 21 else 10.0
    elif days is None or days >= 365:
        want = ape
    elif days <= 21:
        want = 0.0
    elif mode == 12:
        want = ape
    else:
        want = prem * (days // {1: 31, 3: 92, 6: 183}[mode] + 1)
    df = spark.createDataFrame([(days, mode, prem, ape, single)], "d int, m int, p double, a double, s boolean")
    got = df.select(money.adjusted_ape(c("d"), c("m"), c("p"), c("a"), c("s"))).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(
    "day,want",
    [("2001-06-30", -1), ("2001-06-01", -1), ("2001-05-31", -2), ("2000-06-15", -13), ("2000-05-01", -14), ("2000-02-29", -17), ("2001-07-01", 0)],
)
def test_month_offset(spark, day, want):
    snap = F.to_date(F.lit("2001-06-30"))
    assert one(spark, dt.date.fromisoformat(day), "date", lambda x: dates.month_offset(x, snap)) == want


def test_calendar(spark):
    day = dt.date(2001, 3, 31)
    assert one(spark, day, "date", dates.month_end) == dt.date(2001, 2, 28)
    assert one(spark, day, "date", lambda x: dates.month_end(x, 12)) == dt.date(2000, 2, 29)
    assert one(spark, day, "date", lambda x: dates.previous_due(F.lit(1), x)) == dt.date(2001, 2, 28)
    assert one(spark, day, "date", lambda x: dates.previous_due(F.lit(2), x)) is None


@pytest.mark.parametrize("day,want", [("2001-01-01", "2000 Q3"), ("2001-06-30", "2000 Q4"), ("2001-08-31", "2001 Q1"), ("2001-12-31", "2001 Q2")])
def test_lagged_quarter(spark, day, want):
    assert one(spark, dt.date.fromisoformat(day), "date", dates.lagged_quarter) == want


@pytest.mark.parametrize(
    "value,want", [(-1.0, None), (0.0, "a"), (1.0, "a"), (1.5, "b"), (2.0, "b"), (3.0, "c"), (float("inf"), "c"), (None, None)]
)
def test_band(spark, value, want):
    build = lambda x: bands.band(x, [0, 1, 2, bands.INF], ["a", "b", "c"])
    assert one(spark, value, "double", build) == want


def test_band_without_lowest_edge(spark):
    build = lambda x: bands.band(x, [0, 1], ["a"], include_lowest=False)
    assert one(spark, 0.0, "double", build) is None
    with pytest.raises(ValueError):
        bands.band(F.col("x"), [0, 1], ["a", "b"])


@pytest.mark.parametrize(
    "ape,long_held,want",
    [(864.11, 1, None), (864.12, 1, "silver"), (864.12, 0, None), (2808.38, 0, "gold"), (6480.88, 0, "plat"), (12961.76, 0, "elite")],
)
def test_vip(spark, ape, long_held, want):
    assert one(spark, ape, "double", lambda x: vip_label(x, F.lit(long_held))) == want


@pytest.mark.parametrize(
    "gap,same_gender,want",
    [(None, True, "self"), (-18, True, "parent"), (-17, True, "others"), (-17, False, "spouse"), (17, False, "spouse"),
     (18, True, "child"), (40, False, "child"), (41, False, "others")],
)
def test_infer_relation(spark, gap, same_gender, want):
    second = F.lit("F" if same_gender else "M")
    assert one(spark, gap, "int", lambda x: bands.infer_relation(F.lit(0), x, F.lit("F"), second)) == want


def test_relation_label(spark):
    assert [one(spark, v, "string", bands.relation_label) for v in ("01", "02", "03", "51", "52", "99")] == [
        "Self", "Spouse", "Child", "Parent", "Others", None,
    ]


def test_tiers(spark):
    assert one(spark, "Unranked", "string", bands.next_tier) == "Silver"
    assert one(spark, "TOT", "string", bands.next_tier) == "TOT"


def test_money(spark):
    assert one(spark, 0, "int", lambda x: money.safe_ratio(F.lit(1), x)) is None
    assert one(spark, 0, "int", lambda x: money.safe_ratio(F.lit(1), x, 1)) == 1.0
    assert one(spark, 100.0, "double", lambda x: money.gap_to_target(F.lit(60.0), x)) == 0.0
    assert one(spark, None, "double", lambda x: money.gap_to_target(F.lit(60.0), x)) == 60.0
    assert one(spark, None, "double", lambda x: bands.cap(x, 1.0, 2.0)) is None


def test_sums_do_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e6, 0.3, -1e6]
    frames = [spark.createDataFrame([(v,) for v in vs], "x double") for vs in (values, values[::-1])]
    assert {f.agg(money.total("x")).first()[0] for f in frames} == {1.3}
    assert {f.agg(money.total(c("x"))).first()[0] for f in frames} == {1.3}


def test_text(spark):
    assert one(spark, 27, "int", text.years_months) == "2y 3m"
    assert one(spark, None, "string", lambda x: text.labelled(F.lit(3), x)) == "3"


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1.0, 3.0, 3.0)], "a double, b double, d double")
    assert df.select(bands.argmax_columns(["a", "b", "d"])).first()[0] == "b"
