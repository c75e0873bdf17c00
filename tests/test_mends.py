"""Cases that once lost rows or depended on size."""

import uuid

from pyspark.sql import functions as F

from tierline.operators import aggregates as A
from tierline.operators import ordered as O
from tierline.plans import customers as K
from tierline.sources import sink


def test_save_table_keeps_other_months(spark, tmp_path):
    name = "t_" + uuid.uuid4().hex[:8]
    write = lambda rows: sink.save_table(spark.createDataFrame(rows, "v int, month string"), name, ["month"], str(tmp_path / name))
    write([(1, "2001-05")])
    write([(2, "2001-06"), (3, "2001-06")])
    sink.save_table(spark.createDataFrame([("2001-06", 4)], "month string, v int"), name, ["month"])
    assert sorted(map(tuple, spark.table(name).select("month", "v").collect())) == [("2001-05", 1), ("2001-06", 4)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql(f"drop table {name}")


def test_row_on_a_cut_of_six_decimals(spark):
    df = spark.createDataFrame([(i + 0.000061,) for i in range(5)], "v double")
    got = {r["v"]: r["segment"] for r in A.assign_segment(df, ["v"], [0.75, 0.25], ["Top", "High", "Rest"]).collect()}
    assert got[3.000061] == "Top" and got[1.000061] == "High" and got[0.000061] == "Rest"
    cuts = O.percentiles(df, [], "v", {"q": 0.75}).first()
    assert cuts["q"] == 3.000061 and abs(cuts["mean_value"] - 2.000061) < 1e-9


def test_more_conditions_than_a_long_has_bits(spark):
    df = spark.createDataFrame([("a", i, i % 70) for i in range(140)] + [("a", 0, 0), ("b", 5, 3)], "k string, item int, c int")
    windows = {"low": "item < 70", "all": "true"}
    families = {"item": {f"c{i}": f"c = {i}" for i in range(70)}}
    single = {"item": {f"s{i}": f"item % 80 = {i}" for i in range(80)}}
    got = {r["k"]: r.asDict() for r in A.trailing_distinct(df, "k", windows, families, single).collect()}
    assert all(got["a"][f"low_c{i}"] == 1 and got["a"][f"all_c{i}"] == 2 for i in range(70))
    assert got["b"]["all_c3"] == 1 and got["b"]["all_c4"] == 0
    assert sum(got["a"][f"s{i}"] for i in range(80)) == 140


def test_claims_count_by_their_approval(spark):
    claims = [(1, 10, "A", "2001-05-01", "2001-07-02", 5.0), (1, 11, "A", "2000-01-01", "2001-06-01", 7.0)]
    t = {
        "claim": spark.createDataFrame([(*c, 3) for c in claims], "pol_num int, clm_id int, clm_stat_code string, r string, a string, clm_aprov_amt double, clm_code int")
        .withColumns({"clm_recv_dt": F.to_date("r"), "clm_aprov_dt": F.to_date("a")}),
        "policy": spark.createDataFrame([(1, 9, "1")], "pol_num int, po_num int, pol_stat_cd string"),
    }
    row = K.owner_claims(t, "2001-06-30", F.lit(2.0)).first()
    assert (row["clm_6m_cnt"], row["clm_6m_amt"], str(row["clm_lst_dt"])) == (1, 3.5, "2001-06-01")
    assert K.approved_claims(t, "2001-06-30", F.lit(2.0)).first()["claim_amount"] == 3.5


def test_local_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:
            master = "local-cluster[3,2,1000]"
            applicationId = "x"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    try:
        sink.shared_dir(Session)
    except ValueError:
        return
    raise AssertionError("a machine-local folder was taken")
