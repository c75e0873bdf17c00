"""What queries leave on disk: no shuffles of what has been written, no spent stages, no wide rows sent from key to key."""

import re
import time
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F
from test_join_sizes import ROWS, SNAP

from tierline.plans import agents as S
from tierline.plans import customers as K
from tierline.sources import sink
from tierline.sources.views import Tables


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_a_stage_takes_its_shuffles_with_it(spark):
    before = shuffle_files(spark)
    staged = sink.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert staged.count() == 7


def folder(df):
    return Path(unquote(urlparse(df.inputFiles()[0]).path)).parent


def test_only_spent_stages_go(spark):
    one, other = sink.stage(spark.range(3), "spent one"), sink.stage(spark.range(4), "kept")
    gone, stays = folder(one), folder(other)
    both = sink.stage_last(one.union(other), "both", ["spent one"])
    assert not gone.exists() and stays.exists()
    assert sink.stage(both, "again").count() == 7
    assert folder(both).exists()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Agents come twice, with and without a bank; one plan comes twice, and one policy in fifteen."""
    path = tmp_path_factory.mktemp("twice")
    for name, (n, columns) in ROWS.items():
        df = spark.sql(f"select {columns} from range({n})")
        if name == "supplier":
            df = df.unionByName(df.filter("s_suppkey % 3 = 0"))
        if name == "part":
            df = df.unionByName(df.filter("p_partkey = 2").withColumn("p_size", F.lit(7)))
        if name == "orders":
            df = df.unionByName(df.filter("o_orderkey % 15 = 0"))
        df.write.parquet(f"{path}/{name}.parquet")
    t = Tables(spark, str(path))
    agents = t["agent"].withColumn("bank_loc", F.when(F.col("agt_code") % 2 == 0, F.lit("TCB01")))
    t._built["agent"] = t["agent"].unionByName(agents)
    return t


def exchanges(df):
    """First keys of the shuffles in the plan."""
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_values_are_those_of_the_rows_side_by_side(tables):
    """The margin looked up by the coverages alone is the one of the policy's row beside its coverage."""
    quarter = K.dates.lagged_quarter(F.col("cvg_eff_dt"))
    base = K.policy_base(tables, SNAP).filter("pol_stat_cd not in ('6', '8')").withColumn("effective_qtr", quarter)
    beside = K.with_margin(base, tables["plan_margin"], tables["margin_quarter"], K.margin_rules())
    columns = [*base.columns, "nbv_margin"]
    kept = [n for n in columns if n not in ("cvg_prem", "face_amt")]
    got = K.coverage_value(tables, SNAP, F.lit(23.0))
    rows = sorted(map(str, got.select(*kept).collect()))
    assert len({r["channel"] for r in got.collect()}) > 1
    assert rows and rows == sorted(map(str, beside.select(*kept).collect()))


def test_wide_rows_are_not_sent_from_key_to_key(tables):
    """Policies and coverages are sent by policy once, and are summed where they meet."""
    assert exchanges(K.policy_level(K.coverage_value(tables, SNAP, F.lit(23.0)))) in (["pol_num", "_pol"], ["_pol", "pol_num"])


def test_the_fact_is_sent_by_policy_and_insured_only(tables):
    keys = exchanges(S.coverage_fact(tables, SNAP))
    assert sorted(keys) == ["cli_num", "cli_num", "pol_num", "pol_num"]


def test_facts_are_read_where_they_lie(tables):
    assert [n for n in ("coverage", "claim", "policy") if exchanges(tables[n])] == []
    assert len(exchanges(tables["policy_agent"])) == 1
