"""Stand-in business tables over the TPC-H-like test tables.

`VIEW_SQL` is written so that Spark and DuckDB read the same text: `{name}` stands for a base table.
`FIXTURES.md` describes the mapping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Views that shrink a fact table to a row per key read it spread by that key.
FACT_KEYS = {"lineitem": "l_orderkey"}
KEYED_VIEWS = ("policy_agent", "policy_plan", "lapse")

VIEW_SQL: dict[str, str] = {
    "agent": """
select s_suppkey as agt_code, s_name as agt_nm, s_nationkey as loc_cd, s_acctbal as acum_bal,
       date '1994-01-01' + cast((s_suppkey * 20) % 2500 as int) as agt_join_dt,
       case when s_suppkey % 10 = 0 then '04' when s_suppkey % 10 = 1 then '98' else '01' end as comp_prvd_num,
       case when s_suppkey % 12 = 5 then date '2001-01-31' end as trmn_dt,
       cast(s_suppkey % 4 as int) as no_sbw_completed,
       case cast(s_suppkey % 7 as int) when 0 then 'TOT' when 1 then 'COT' when 2 then 'MDRT' when 3 then 'Platinum'
            when 4 then 'Gold' when 5 then 'Silver' else 'Unranked' end as tier,
       case when s_suppkey % 4 = 1 then '1mAA' when s_suppkey % 4 = 2 then '3mAA' end as agent_tier,
       case cast(s_suppkey % 5 as int) when 0 then 'TCB01' when 1 then 'SAG02' when 2 then 'XX03' end as bank_loc,
       concat('I', cast(s_suppkey * 7 as varchar(20))) as id_num,
       concat('P', cast(s_suppkey % 40 as varchar(20))) as per_nm,
       date '1940-01-01' + cast((s_suppkey % 40) * 400 as int) as birth_dt,
       case when s_suppkey % 2 = 0 then 'F' else 'M' end as sex_code,
       concat('c', cast(s_suppkey * 3 as varchar(20)), '@x') as email_addr,
       concat('m', cast(s_suppkey % 120 as varchar(20))) as mobl_phon_num
from {supplier}""",
    "training": """
select s_suppkey as agt_code, cast(s_suppkey % 3 as int) as slot_set,
       case when s_suppkey % 2 = 0 then s_nationkey end as sbw01,
       case when s_suppkey % 3 = 0 then s_nationkey end as sbw02,
       case when s_suppkey % 5 = 0 then s_nationkey end as sbw03,
       case when s_suppkey % 7 = 0 then s_nationkey end as sbw04
from {supplier}""",
    "location": """
select n_nationkey as loc_cd, n_name as city, r_name as region,
       case when n_nationkey % 3 = 0 then concat('L0_', n_name) end as manager_name_0,
       case when n_nationkey % 2 = 0 then concat('L1_', n_name) end as manager_name_1,
       case when n_nationkey % 5 <> 1 then concat('L2_', n_name) end as manager_name_2
from {nation} join {region} on n_regionkey = r_regionkey""",
    "client": """
select c_custkey as cli_num, c_name as cli_nm, case when c_acctbal < 0 then null else c_acctbal * 23 end as mthly_incm,
       c_mktsegment as customer_segment, c_nationkey as city_cd, cast(18 + c_custkey % 60 as int) as cur_age,
       case when c_custkey % 2 = 0 then 'F' else 'M' end as sex_code,
       case when c_custkey % 3 = 0 then cast(c_custkey % 5 as int) end as no_dpnd,
       case when c_custkey % 4 <> 0 then concat('c', cast(c_custkey as varchar(20)), '@x') end as email_addr,
       concat('I', cast(c_custkey as varchar(20))) as id_num,
       concat('P', cast(c_custkey % 40 as varchar(20))) as per_nm,
       date '1940-01-01' + cast((c_custkey % 40) * 400 as int) as birth_dt,
       concat('m', cast(c_custkey % 120 as varchar(20))) as mobl_phon_num
from {customer}""",
    "policy": """
select o_orderkey as pol_num, o_custkey as po_num, cast(o_orderdate as date) as pol_eff_dt,
       case when o_orderkey % 20 = 0 then 'A' when o_orderkey % 20 = 1 then 'N' when o_orderkey % 20 = 2 then 'R'
            when o_orderstatus = 'F' then 'B' when o_orderstatus = 'P' then '3' else '1' end as pol_stat_cd,
       case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 1500 as int) end as pol_trmn_dt,
       case cast(substr(o_orderpriority, 1, 1) as int) when 1 then 1 when 2 then 3 when 3 then 6 else 12 end as pmt_mode,
       o_totalprice as tot_ape,
       cast(o_orderdate as date) + cast(o_orderkey % 3000 as int) as xpry_dt,
       cast(o_orderdate as date) + cast(o_orderkey % 400 as int) as pd_to_dt,
       case cast(o_orderkey % 8 as int) when 0 then '01' when 1 then '03' when 2 then '48' when 3 then '09'
            when 4 then '05' when 5 then '*' when 6 then '77' else '02' end as dist_chnl_cd,
       case cast(o_orderkey % 3 as int) when 0 then 'CHEQUE' when 1 then 'CASH' else 'TRANSFER' end as lst_pmt_mthd
from {orders}""",
    "policy_agent": """
select l_orderkey as pol_num, min(l_suppkey) as wa_code, max(l_suppkey) as sa_code
from {lineitem} group by l_orderkey""",
    "policy_plan": """
select l_orderkey as pol_num, min(l_partkey) as plan_code, max(l_partkey) as last_plan_code
from {lineitem} group by l_orderkey""",
    "coverage": """
select l_orderkey as pol_num, l_linenumber as cvg_num, l_partkey as plan_code, l_suppkey as wa_code,
       cast(l_shipdate as date) as cvg_eff_dt, l_extendedprice as cvg_prem, l_quantity as prem_dur,
       case when l_returnflag = 'R' then 'R' else 'B' end as cvg_typ, l_linestatus as cvg_stat_cd,
       l_extendedprice * 10 as face_amt, l_tax as nbv_margin,
       case when l_linenumber = 3 then cast(l_shipdate as date) + 200 end as cvg_del_dt,
       case when l_linenumber <> 1 then l_partkey end as insrd_num,
       case l_linenumber when 1 then '01' when 2 then '02' when 3 then '03' when 4 then '04'
            when 5 then '05' when 6 then '51' else '10' end as rel_to_insrd
from {lineitem}""",
    "insured": """
select l_orderkey as pol_num, l_linenumber as cvg_num, o_custkey as po_num,
       case when l_linenumber = 1 then o_custkey else l_partkey end as cli_num,
       case l_linenumber when 1 then '01' when 2 then '02' when 3 then '03' when 4 then '04'
            when 5 then '05' when 6 then '51' else '10' end as rel_to_insrd
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "plan": """
select p_partkey as plan_code, p_type as ins_typ_desc, p_brand as plan_grp,
       case when p_size % 10 = 0 then 'Y' else 'N' end as sngl_prem_ind,
       case when p_size <= 40 then p_size / 100.0e0 end as nbv_margin_a, p_retailprice / 10000.0e0 as nbv_margin_b
from {part}""",
    "margin_history": """
select plan_code, effective_date, (p_size + month(effective_date)) / 100.0e0 as nbv_margin
from (select p_partkey as plan_code, p_size, {EXPLODE} as effective_date
      from {part} where p_size <= 40) q""",
    "plan_margin": """
select p_partkey as plan_code, p_size / 90.0e0 as nbv_margin_agency_affinity,
       case when p_size <= 40 then p_size / 100.0e0 end as nbv_margin_agency,
       case when p_size % 3 <> 0 then p_size / 110.0e0 end as nbv_margin_dmtm,
       case when p_size % 4 <> 0 then p_size / 120.0e0 end as nbv_margin_other_channel_affinity,
       p_retailprice / 10000.0e0 as nbv_margin_other_channel,
       case when p_size % 5 <> 0 then p_size / 130.0e0 end as nbv_margin_banca_other_banks,
       case when p_size % 6 <> 0 then p_size / 140.0e0 end as nbv_margin_banca_scb,
       case when p_size % 7 <> 0 then p_size / 150.0e0 end as nbv_margin_banca_tcb
from {part}""",
    "margin_quarter": """
select plan_code, concat(cast(year(effective_date) as varchar(4)), ' Q', cast(quarter(effective_date) as varchar(1))) as effective_qtr,
       (p_size + month(effective_date)) / 190.0e0 as nbv_margin_agency_affinity,
       (p_size + month(effective_date)) / 200.0e0 as nbv_margin_agency,
       (p_size + month(effective_date)) / 210.0e0 as nbv_margin_dmtm,
       (p_size + month(effective_date)) / 220.0e0 as nbv_margin_other_channel_affinity,
       (p_size + month(effective_date)) / 230.0e0 as nbv_margin_other_channel,
       case when p_size % 2 = 0 then (p_size + month(effective_date)) / 240.0e0 end as nbv_margin_banca_other_banks,
       (p_size + month(effective_date)) / 250.0e0 as nbv_margin_banca_scb,
       (p_size + month(effective_date)) / 260.0e0 as nbv_margin_banca_tcb
from (select p_partkey as plan_code, p_size, {EXPLODE} as effective_date
      from {part}) q""",
    "claim": """
select l_orderkey as pol_num, l_orderkey * 10 + l_linenumber as clm_id,
       case l_returnflag when 'A' then 'A' when 'R' then 'I' else 'D' end as clm_stat_code,
       cast(l_shipdate as date) as clm_recv_dt, cast(l_shipdate as date) + cast(l_orderkey % 75 as int) as clm_aprov_dt,
       l_extendedprice as clm_prvd_amt,
       l_extendedprice * (1 - l_discount) as clm_aprov_amt, cast(l_partkey % 60 as int) as clm_code
from {lineitem}""",
    "lapse": """
select l_orderkey as pol_num, max(l_discount) + 0.0e0 as lapse_score, cast(1 + l_orderkey * 3 % 10 as int) as next_due_decile
from {lineitem} where l_orderkey % 3 = 0 group by l_orderkey""",
    "early_lapse": """
select o_orderkey as pol_num, (o_orderkey * 11 % 100) / 100.0e0 as p_1, cast(1 + o_orderkey % 10 as int) as decile
from {orders} where o_orderkey % 4 = 0""",
    "score": """
select c_custkey as po_num, (c_custkey * 7 % 100) / 100.0e0 as health_base, (c_custkey * 13 % 100) / 100.0e0 as inv_base,
       (c_custkey * 29 % 100) / 100.0e0 as health_rider, (c_custkey * 31 % 100) / 100.0e0 as riders,
       (c_custkey * 37 % 1000) / 1000.0e0 as p_1,
       case when c_custkey % 6 = 0 then 'PENDING' else 'APPROVED' end as deployment_approval_status
from {customer} where c_custkey % 5 <> 0""",
    "new_score": """
select c_custkey as po_num, cast(1 + c_custkey * 3 % 10 as int) as ci_decile, cast(1 + c_custkey * 7 % 10 as int) as invst_decile,
       cast(1 + c_custkey * 9 % 10 as int) as lt_decile
from {customer} where c_custkey % 5 = 0 and c_custkey % 3 <> 0""",
    "existing_score": """
select c_custkey as cli_num, cast(1 + c_custkey * 3 % 10 as int) as decile_inv, cast(2 + c_custkey * 7 % 9 as int) as decile_ci,
       cast(3 + c_custkey * 11 % 8 as int) as decile_lp, case when c_custkey % 7 <> 0 then cast(1 + c_custkey * 13 % 10 as int) end as decile_lt,
       cast(4 + c_custkey * 17 % 7 as int) as decile_acc, cast(2 + c_custkey * 19 % 9 as int) as decile_med
from {customer} where c_custkey % 5 <> 0""",
    "income_survey": """
select c_custkey as cli_num, cast(k as int) as survey_num, (abs(c_acctbal) + c_custkey % 1000 * (k + 1)) * 20 as avg_mth_income
from {customer}, (select 0 as k union all select 1 as k) n where c_custkey % 4 <> 1""",
    "campaign": """
select c_custkey as tgt_cust_id, date '2000-12-15' + cast(c_custkey * 17 % 180 as int) + k * 60 as lead_dt
from {customer}, (select 0 as k union all select 1 as k) n where c_custkey * 37 % 1000 > 500""",
    "portal_account": """
select user_id as cli_num, case when user_id % 6 <> 0 then user_id * 2 end as acc_id from {events} group by user_id""",
    "portal_hit": """
select event_id, user_id * 2 as login_id, ts as date_time, cast(event_id % 10 as varchar(2)) as hit_source,
       case when event_id % 11 = 0 then 1 else 0 end as exclude_hit, case when event_id % 13 <> 0 then event_id end as visitor,
       case when event_id % 4 <> 3 then '/portfolio/policies' else '/home' end as page,
       case event_id % 5 when 0 then 'portal-old' when 1 then 'elsewhere' else 'portal' end as server
from {events}""",
    "rate": """
select 'U' as rate_typ, '78' as ccy, effective_date as fr_eff_dt,
       23000 + 5 * (year(effective_date) - 1995) + month(effective_date) as xchng_rate
from (select distinct cast(date_trunc('month', o_orderdate) as date) as effective_date from {orders}) m""",
    "account": """
select user_id as cli_num, user_id as login_id, cast(min(ts) as date) as activation_date
from {events} group by user_id, event_type""",
    "hit": """
select event_id, user_id as login_id, ts as date_time, event_type, value, cast(event_id % 10 as varchar(2)) as hit_source
from {events}""",
}

# One row per plan and quarter start, made by exploding the calendar's quarters on each plan row.
_EXPLODE = {
    "spark": "explode((select array_sort(collect_set(cast(date_trunc('quarter', o_orderdate) as date))) from {orders}))",
    "duckdb": "unnest((select list_sort(list(distinct cast(date_trunc('quarter', o_orderdate) as date))) from {orders}))",
}


def view_text(name: str, engine: str) -> str:
    return VIEW_SQL[name].replace("{EXPLODE}", _EXPLODE[engine])


def duckdb_text(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", view_text(name, "duckdb"))


class Tables(Mapping):
    """Base tables and stand-in views of one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in VIEW_SQL:
                text = view_text(name, "spark")
                used = {b: self._spread(b) if name in KEYED_VIEWS else self[b] for b in set(re.findall(r"\{(\w+)\}", text))}
                self._built[name] = self.spark.sql(text, **used)
            else:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._built[name]

    def _spread(self, name: str) -> DataFrame:
        """Raw rows meet at their key once. Summed on both sides of a shuffle, rows in no order would hardly shrink before it."""
        return self[name].repartition(FACT_KEYS[name]) if name in FACT_KEYS else self[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*BASE_TABLES, *VIEW_SQL])

    def __len__(self) -> int:
        return len(BASE_TABLES) + len(VIEW_SQL)
