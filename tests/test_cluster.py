"""Clusters on a small client-level frame."""

import pytest
from pyspark.sql import functions as F

from tierline.plans import cluster as C
from tierline.sources import sink


@pytest.fixture(scope="module")
def level(spark):
    cols = {n: (F.rand(i) * 10) for i, n in enumerate([*C.SPARSE, *C.CODES, *C.MEASURES])}
    df = spark.range(600).withColumnRenamed("id", "po_num").select("po_num", *[v.alias(n) for n, v in cols.items()])
    gaps = df.withColumn("mthly_incm", F.when(F.col("po_num") % 4 != 0, F.col("mthly_incm")))
    gaps = gaps.withColumn("yr_2nd_prod", F.when(F.col("po_num") % 3 != 0, F.col("yr_2nd_prod")))
    return sink.stage(gaps)


def test_sample_is_the_same_on_any_partitioning(level):
    a = {r[0] for r in C.sample_rows(level, "po_num", 0.3, 123).select("po_num").collect()}
    b = {r[0] for r in C.sample_rows(level.repartition(7), "po_num", 0.3, 123).select("po_num").collect()}
    assert a == b and 120 < len(a) < 240


def test_elbow_falls(level):
    costs = [r["inertia"] for r in C.cluster_elbow(level, share=1.0, largest=4).orderBy("k").collect()]
    assert len(costs) == 4
    assert all(x >= y for x, y in zip(costs, costs[1:]))


def plain_fit(points, k, rounds=C.ROUNDS):
    """k-means over whole numbers, as a loop."""
    order = sorted(points, key=lambda p: (p[1][0], p[0]))
    centres = [order[(2 * j + 1) * len(order) // (2 * k)][1] for j in range(k)]
    near = lambda x: min(range(k), key=lambda j: (sum((float(a) - float(b)) ** 2 for a, b in zip(x, centres[j])), j))
    for _ in range(rounds):
        held = [[x for _, x in points if near(x) == j] for j in range(k)]
        centres = [[(2 * sum(v) + len(h)) // (2 * len(h)) for v in zip(*h)] if h else c for h, c in zip(held, centres)]
    return centres, {key: near(x) for key, x in points}


def test_fit_and_scores_equal_a_plain_loop(level):
    model = C.fit_centres(level, k=3, share=1.0)
    ready = C.cluster_features(level, model.means, model.scales)
    points = [(r["po_num"], list(r["features"])) for r in ready.collect()]
    centres, where = plain_fit(points, 3)
    assert model.centres[3] == centres
    assert {r["po_num"]: r["clusters"] for r in C.customer_clusters(level, model, 3).collect()} == where


def test_fit_is_the_same_on_any_partitioning(level):
    assert C.fit_centres(level, k=4) == C.fit_centres(level.repartition(9), k=4)


def test_features_fill_gaps(spark, level):
    gaps = level.select("po_num", *[F.when(F.col("po_num") != 5, F.col(n)).alias(n) for n in C.FEATURES])
    model = C.fit_centres(gaps, k=2, share=1.0)
    row = C.cluster_features(gaps.filter("po_num = 5"), model.means, model.scales).first()["features"]
    n, m = len(C.MEASURES), len(C.SPARSE)
    assert row == [0] * n + [99 * C.UNIT] * m + [0] * len(C.CODES)


def test_centre_table_holds_the_model(spark, level):
    model = C.fit_centres(level, k=3)
    rows = C.centre_table(spark, model).collect()
    back = {(r["cluster"], r["feature"]): round(r["centre"] * C.UNIT) for r in rows}
    assert back == {(j, n): v for j, centre in enumerate(model.centres[3]) for n, v in zip(C.FEATURES, centre)}


def test_no_customers_to_fit_on(level):
    with pytest.raises(ValueError):
        C.fit_centres(level.filter("po_num < 0"))


def test_everyone_is_scored_and_a_saved_model_scores_the_same(spark, level):
    prep, model = C.fit_clusters(level, k=3)
    out = C.predicted_clusters(level, prep, model)
    assert out.count() == level.count()
    assert out.select("clusters").distinct().count() == 3
    path = sink.fresh_path(spark, "model")
    C.save_model(prep, model, path)
    again = C.predicted_clusters(level, *C.load_model(spark, path))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
