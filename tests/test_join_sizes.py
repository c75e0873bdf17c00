"""Sides of joins that hold far more rows than the size of their files tells: they are not sent through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from tierline.operators import joins as J
from tierline.plans import activation as X
from tierline.plans import agents as S
from tierline.plans import cluster as C
from tierline.plans import customers as K
from tierline.sources.views import Tables


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def dates_per_plan(spark):
    """One row per plan and month, unfolded from an array as the margins are."""
    days = F.expr("explode(sequence(date '2000-01-01', date '2001-12-01', interval 1 month))")
    return spark.range(3).select(F.col("id").alias("k"), days.alias("e"))


def test_unfolded_dates_are_merged(spark):
    left = spark.createDataFrame([(0, "2000-03-10"), (0, "2000-03-10"), (1, "1999-12-31"), (None, "2000-05-05"), (9, "2000-05-05")], "k long, d string")
    left = left.withColumn("d", F.to_date("d"))
    for how, rows in (("inner", 6), ("left", 9)):
        pairs = J.interval_join(left, dates_per_plan(spark), ["k"], "d", "e", 0, 2, how)
        assert broadcasts(pairs) == 0
        assert pairs.count() == rows


ROLES = ["agency", "dmtm", "other_channel", "other_channel_affinity", "banca_other_banks", "banca_scb", "banca_tcb"]


def test_margins_of_unfolded_quarters_are_merged(spark):
    # Two rows of one plan: each counts for the roles that it has a margin in.
    own = {0: (1, {"agency": 0.1}), 1: (1, {"agency": 0.2, "dmtm": 0.3}), 2: (2, {}), 3: (None, dict.fromkeys(ROLES, 9.0))}
    plan = F.create_map(*[F.lit(x) for i, (plan, _) in own.items() if plan for x in (i, plan)])
    static = spark.range(4).select(
        plan[F.col("id").cast("int")].alias("plan_code"),
        *[F.coalesce(*[F.when(F.col("id") == i, F.lit(held.get(r))) for i, (_, held) in own.items()]).cast("double").alias(f"nbv_margin_{r}") for r in ROLES],
    )
    days = spark.range(3).select(F.expr("if(id < 2, 2, 3)").alias("plan_code"), F.expr("explode(array('2001 Q1', '2001 Q2'))").alias("effective_qtr"))
    dated = days.select("*", *[F.lit(float(i)).alias(f"nbv_margin_{r}") for i, r in enumerate(ROLES)])
    rows = [(1, "2001 Q1", None, "01", 0), (1, "2001 Q1", None, "05", 1), (2, "2001 Q2", None, "05", 2), (2, "2001 Q3", None, "05", 3),
            (None, "2001 Q1", None, "05", 4), (2, "2001 Q1", None, "09", 5), (3, "2001 Q1", "TCB1", "05", 6), (3, None, "TCB1", "05", 7)]
    df = spark.createDataFrame(rows, "plan_code int, effective_qtr string, loc_cd string, dist_chnl_cd string, id int")
    got = K.with_margin(df, static, dated, K.margin_rules())
    assert broadcasts(got) == 0
    found = sorted((r["id"], None if r["nbv_margin"] is None else round(r["nbv_margin"], 4)) for r in got.collect())
    assert found == [(0, 0.1), (0, 0.2), (1, 0.3), (2, 1.0), (2, 1.0), (3, None), (4, None), (5, -1.3404), (6, 6.0), (7, None)]


SNAP = "2001-06-30"
#: Base tables of a few rows: orders 0 to 39 have one to three lines each.
ROWS = {
    "region": (2, "cast(id as int) r_regionkey, concat('R', id) r_name"),
    "nation": (5, "cast(id as int) n_nationkey, concat('N', id) n_name, cast(id % 2 as int) n_regionkey"),
    "customer": (12, "id c_custkey, concat('C', id) c_name, cast(id % 5 as int) c_nationkey, id * 10.0d c_acctbal, 'FAMILY' c_mktsegment"),
    "supplier": (12, "id s_suppkey, concat('S', id) s_name, cast(id % 5 as int) s_nationkey, id * 1.0d s_acctbal"),
    "part": (9, "id p_partkey, concat('P', id) p_name, 'B' p_brand, 'Term Life' p_type, cast(id * 6 as int) p_size, 900.0d p_retailprice"),
    "orders": (40, """id o_orderkey, id % 12 o_custkey, if(id % 4 = 3, 'F', 'O') o_orderstatus, id * 100.0d o_totalprice,
                   timestamp_ntz '2001-06-01' - make_dt_interval(cast(id * 20 as int)) o_orderdate, '1-URGENT' o_orderpriority"""),
    "lineitem": (90, """id % 40 l_orderkey, id % 9 l_partkey, id % 12 l_suppkey, cast(1 + id / 40 as int) l_linenumber, 5.0d l_quantity, id * 1000.0d l_extendedprice,
                     0.05d l_discount, 0.02d l_tax, if(id % 3 = 0, 'A', 'N') l_returnflag, 'O' l_linestatus, timestamp_ntz '2001-06-01' - make_dt_interval(cast(id % 40 * 20 as int)) l_shipdate"""),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("few")
    for name, (n, columns) in ROWS.items():
        spark.sql(f"select {columns} from range({n})").write.parquet(f"{path}/{name}.parquet")
    return Tables(spark, str(path))


def sent_by(df):
    """First keys of the joins that send a side to every task."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().sparkPlan().toString()))


def values(t):
    return K.policy_level(K.coverage_value(t, SNAP, F.lit(23.0)))


def owners(t):
    return t["client"].select(F.col("cli_num").alias("po_num"))


# Agents alone are sent: sides with a row per policy, owner or plan are merged, though all of these files are small.
AGENTS = {"agt_code", "wa_cd_1", "wa_code", "sa_code", "_wa", "_sa"}
PLANS = {
    "coverage_fact": lambda t: S.coverage_fact(t, SNAP),
    "recent_sellers": lambda t: S.recent_sellers(t, SNAP),
    "coverage_value": lambda t: K.coverage_value(t, SNAP, F.lit(23.0)),
    "policy_ltv": lambda t: K.policy_ltv(t, SNAP, F.lit(23.0)),
    "first_second_product": K.first_second_product,
    "agent_assignment": K.agent_assignment,
    "owner_is_agent": K.owner_is_agent,
    "recent_sales": lambda t: K.recent_sales(t, SNAP, 60),
    "owner_payments": lambda t: K.owner_payments(t, F.lit(23.0)),
    "product_types": lambda t: K.product_types(t, SNAP),
    "serving_agents": lambda t: X.serving_agents(t, owners(t)),
    "agent_customers": lambda t: X.agent_customers(t, K.vip_segment(values(t))),
    "cluster_profiles": lambda t: C.cluster_profiles(
        owners(t).selectExpr("po_num", *[f"1.0d as {m[2]}" for m in C.CLUSTER_MEASURES[1:]]), owners(t).withColumn("clusters", F.lit(0))
    ),
}


@pytest.mark.parametrize("name", PLANS)
def test_sides_that_grow_are_merged(tables, name):
    assert sent_by(PLANS[name](tables)) <= AGENTS


EVENTS = "id event_id, timestamp_ntz '2001-01-01' + make_dt_interval(cast(id as int)) ts, id % 12 user_id, concat('T', id % 3) event_type, 1.0d value, '' props"


def test_no_plan_holds_all_sides_of_the_owners(spark, tables, monkeypatch):
    """Joins in one plan of client_level: the sides join in groups, and what is written between gives the same rows."""
    spark.sql(f"select {EVENTS} from range(80)").write.parquet(f"{tables.sf_dir}/events.parquet")
    plans = []
    write = K.stage

    def counted(df, label="stage"):
        plans.append(df)
        return write(df, label)

    monkeypatch.setattr(K, "stage", counted)
    cut = K.client_level(tables, SNAP, SNAP, F.lit(23.0))
    whole = K.client_level(tables, SNAP, SNAP, F.lit(23.0), cut=False)
    joined = [len(re.findall(r"(?:SortMerge|Hash)Join ", df._jdf.queryExecution().sparkPlan().toString())) for df in (*plans, cut, whole)]
    assert max(joined[:-1]) <= 16 < joined[-1]
    assert cut.columns == whole.columns
    rows = sorted(map(str, cut.collect()))
    assert rows and rows == sorted(map(str, whole.collect()))
