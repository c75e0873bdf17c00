"""One query per single operator, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.catalog.base import (
    SNAP,
    average,
    money,
    money0,
    months_between,
    offset,
    query,
    windows,
)
from tierline.functions import bands, dates, text
from tierline.functions import money as M
from tierline.operators import aggregates as A
from tierline.operators import filters as P
from tierline.operators import joins as J
from tierline.operators import ordered as O
from tierline.operators import ranking as R
from tierline.operators import sets as U
from tierline.operators import shape as H
from tierline.sources import scan, sink

c = F.col


def snap_day():
    return F.to_date(F.lit(SNAP))

# ---------------------------------------------------------------- sources and sinks


@query("scan_parquet", "select o_orderkey, o_totalprice from orders")
def _(t):
    return scan.scan_parquet(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query(
    "scan_snapshot",
    "select pol_num, tot_ape, year(pol_eff_dt) as eff_year from policy where year(pol_eff_dt) = 2000",
)
def _(t):
    path = sink.fresh_path(t.spark, "snapshots")
    rows = t["policy"].select("pol_num", "tot_ape", F.year("pol_eff_dt").alias("eff_year"))
    sink.write_partitions(rows, path, ["eff_year"])
    return scan.scan_snapshot(t.spark, path, "eff_year", 2000)


_POLICY_TEXT = "select pol_num, po_num, pol_stat_cd, tot_ape from policy"


@query("scan_csv", _POLICY_TEXT)
def _(t):
    path = sink.fresh_path(t.spark, "csv")
    sink.export_csv(t["policy"].select("pol_num", "po_num", "pol_stat_cd", "tot_ape"), path)
    return scan.scan_csv(t.spark, path, "pol_num long, po_num long, pol_stat_cd string, tot_ape double")


@query(
    "scan_csv_checked",
    """select pol_stat_cd, count(*) as n, sum(case when pol_num % 7 = 0 then 1 else 0 end) as n_bad from policy group by pol_stat_cd""",
)
def _(t):
    """Every seventh policy number is no number: its line is counted from the lines that do not fit."""
    path = sink.fresh_path(t.spark, "csv")
    number = F.when(c("pol_num") % 7 == 0, F.concat(F.lit("no"), "pol_num")).otherwise(c("pol_num").cast("string"))
    sink.export_csv(t["policy"].select(number.alias("pol_num"), "pol_stat_cd"), path)
    wanted = T.StructType().add("pol_num", "long").add("pol_stat_cd", "string")
    rows, lines = scan.scan_csv_checked(t.spark, path, wanted)
    bad = lines.select(F.substring_index("line", ",", -1).alias("pol_stat_cd"), F.lit(1).alias("bad"))
    both = rows.select("pol_stat_cd", F.lit(0).alias("bad")).unionByName(bad)
    return both.groupBy("pol_stat_cd").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"))


@query(
    "scan_snapshot_or_latest",
    """select pol_num, tot_ape, year(pol_eff_dt) as eff_year from policy where year(pol_eff_dt) = (select coalesce(
       max(case when year(pol_eff_dt) <= 1996 then year(pol_eff_dt) end), max(year(pol_eff_dt))) from policy)""",
)
def _(t):
    path = sink.fresh_path(t.spark, "snapshots")
    rows = t["policy"].select("pol_num", "tot_ape", F.year("pol_eff_dt").alias("eff_year"))
    sink.write_partitions(rows, path, ["eff_year"])
    return scan.scan_snapshot_or_latest(t.spark, path, "eff_year", 1996)


@query("scan_table", "select pol_stat_cd, count(*) as n from policy group by pol_stat_cd")
def _(t):
    t["policy"].createOrReplaceTempView("tierline_policy")
    return A.crosstab_counts(scan.scan_table(t.spark, "tierline_policy"), ["pol_stat_cd"])


@query(
    "load_tables",
    "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name",
)
def _(t):
    found = scan.load_tables(
        t.spark, [f"{t.sf_dir}/absent", t.sf_dir], ["nation", "region"], register=False, suffix=".parquet"
    )
    both = found["NATION"].join(found["REGION"], c("n_regionkey") == c("r_regionkey"))
    return A.crosstab_counts(both, ["r_name"])


@query(
    "snapshot_or_latest",
    f"""select ccy, xchng_rate from rate where fr_eff_dt = (select coalesce(
        max(case when fr_eff_dt <= date '{SNAP}' then fr_eff_dt end), max(fr_eff_dt)) from rate)""",
)
def _(t):
    return scan.snapshot_or_latest(t["rate"], "fr_eff_dt", snap_day()).select("ccy", "xchng_rate")


@query("materialise", f"select pol_stat_cd, {money('tot_ape')} as ape from policy group by pol_stat_cd")
def _(t):
    kept = sink.materialise(t["policy"].select("pol_stat_cd", "tot_ape"), sink.fresh_path(t.spark, "mat"))
    return kept.groupBy("pol_stat_cd").agg(M.total(c("tot_ape")).alias("ape"))


@query(
    "write_partitions",
    f"""select pol_stat_cd, count(*) as n, {money("case when pol_stat_cd = 'B' then 1 else tot_ape end")} as ape
        from policy group by pol_stat_cd""",
)
def _(t):
    path = sink.fresh_path(t.spark, "parts")
    rows = t["policy"].select("pol_num", "tot_ape", "pol_stat_cd")
    sink.write_partitions(rows, path, ["pol_stat_cd"])
    again = rows.filter(c("pol_stat_cd") == "B").withColumn("tot_ape", F.lit(1.0))
    sink.write_partitions(again, path, ["pol_stat_cd"])
    back = t.spark.read.schema("pol_num long, tot_ape double, pol_stat_cd string").parquet(path)
    return back.groupBy("pol_stat_cd").agg(F.count("*").alias("n"), M.total(c("tot_ape")).alias("ape"))


@query(
    "save_table",
    """select region, case when region = 'ASIA' then concat(city, ' again') else city end as city, count(*) as n
       from location group by 1, 2""",
)
def _(t):
    path = sink.fresh_path(t.spark, "table")
    name = "tierline_" + path[-12:]
    rows = t["location"].select("loc_cd", "city", "region")
    sink.save_table(rows, name, ["region"], path)
    again = rows.where("region = 'ASIA'").select("region", F.concat("city", F.lit(" again")).alias("city"), "loc_cd")
    sink.save_table(again, name, ["region"], path)
    return A.crosstab_counts(scan.scan_table(t.spark, name), ["region", "city"])


@query("export_csv", "select agt_code, tier, acum_bal from agent")
def _(t):
    path = sink.fresh_path(t.spark, "export")
    sink.export_csv(t["agent"].select("agt_code", "tier", "acum_bal"), path)
    return scan.scan_csv(t.spark, path, "agt_code long, tier string, acum_bal double")


@query("unwrap_record", "select pol_num, pol_stat_cd, cast(null as varchar) as note from policy")
def _(t):
    record = F.struct("pol_num", "pol_stat_cd", F.lit(None).alias("note"))
    return scan.unwrap_record(t["policy"].select(record.alias("record")), "record")


# ---------------------------------------------------------------- schema shaping


@query(
    "ensure_columns",
    "select loc_cd, city, cast(null as varchar) as channel, cast(null as double) as area from location",
)
def _(t):
    return H.ensure_columns(
        t["location"].select("loc_cd", "city"), {"city": "string", "channel": "string", "area": "double"}
    )


@query("lower_columns", "select loc_cd, city as city_nm from location")
def _(t):
    upper = t["location"].select(c("loc_cd").alias("LOC_CD"), c("city").alias("City_Nm"))
    return H.lower_columns(upper)


@query("strip_names", "select po_num, health_base, riders from score")
def _(t):
    long = t["score"].select(
        "po_num", c("health_base").alias("m_health_base_PRED"), c("riders").alias("m_riders_PRED")
    )
    return H.strip_names(long, "m_", "_PRED")


@query("rename", "select agt_code as agt_cd, tier as agent_tier from agent")
def _(t):
    return H.rename(t["agent"].select("agt_code", "tier"), {"agt_code": "agt_cd", "tier": "agent_tier"})


@query(
    "cast_family",
    "select cast(pmt_mode as bigint) as pmt_mode, cast(cast(tot_ape as decimal(12,2)) as double) as ape, pol_num from policy",
)
def _(t):
    typed = t["policy"].select("pmt_mode", c("tot_ape").cast("decimal(12,2)").alias("ape"), "pol_num")
    return H.cast_family(H.cast_family(typed, T.DecimalType, "double"), H.INTEGERS, "long")


@query(
    "fill_nulls",
    """select cli_num, coalesce(mthly_incm, 0) as mthly_incm, coalesce(no_dpnd, -1) as no_dpnd,
       coalesce(email_addr, 'N/A') as email_addr from client""",
)
def _(t):
    some = t["client"].select("cli_num", "mthly_incm", "no_dpnd", "email_addr")
    return H.fill_nulls(H.fill_nulls(H.fill_nulls(some, {"no_dpnd": -1}), 0), "N/A")


@query("project", "select agt_code, loc_cd, tier from agent")
def _(t):
    some = H.project(t["agent"], ["agt_code", "loc_cd", "tier", "agt_nm"])
    return H.project(some, ["agt_nm"], drop=True)


# ---------------------------------------------------------------- filters


@query(
    "filter_compound",
    """select pol_num, pmt_mode, tot_ape from policy
       where pol_stat_cd <> 'A' and pmt_mode = 12 and (tot_ape > 300000 or pol_trmn_dt is null)""",
)
def _(t):
    some = P.filter_compound(
        t["policy"],
        [c("pol_stat_cd") != "A", c("pmt_mode") == 12],
        [c("tot_ape") > 300000, c("pol_trmn_dt").isNull()],
    )
    return some.select("pol_num", "pmt_mode", "tot_ape")


@query(
    "filter_codes",
    "select pol_num, pol_stat_cd from policy where pol_stat_cd not in ('A','N','R') and dist_chnl_cd in ('01','02','*')",
)
def _(t):
    some = P.filter_codes(t["policy"], "pol_stat_cd", ["A", "N", "R"], keep=False)
    return P.filter_codes(some, "dist_chnl_cd", ["01", "02", "*"]).select("pol_num", "pol_stat_cd")


@query("filter_nulls", "select cli_num from client where mthly_incm is not null and no_dpnd is null")
def _(t):
    return P.filter_nulls(t["client"], ["mthly_incm"], ["no_dpnd"]).select("cli_num")


@query(
    "filter_between",
    f"select pol_num, {offset('pol_eff_dt')} as mth from policy where {offset('pol_eff_dt')} between -12 and -1",
)
def _(t):
    mth = dates.month_offset(c("pol_eff_dt"), snap_day())
    return P.filter_between(t["policy"], mth, -12, -1).select("pol_num", mth.alias("mth"))


@query("filter_like", "select agt_code, bank_loc from agent where bank_loc like 'TCB%' or bank_loc like '%03'")
def _(t):
    return P.filter_like(t["agent"], "bank_loc", ["TCB%", "%03"]).select("agt_code", "bank_loc")


@query("filter_asof", f"select pol_num, cvg_num, cvg_prem from coverage where cvg_eff_dt <= date '{SNAP}'")
def _(t):
    return P.filter_asof(t["coverage"], "cvg_eff_dt", snap_day()).select("pol_num", "cvg_num", "cvg_prem")


@query(
    "filter_window_pair",
    f"""select pol_num, pol_stat_cd from policy where pol_trmn_dt <= date '{SNAP}' and pol_eff_dt <= date '{SNAP}'""",
)
def _(t):
    return P.filter_window_pair(t["policy"], "pol_eff_dt", "pol_trmn_dt", snap_day()).select("pol_num", "pol_stat_cd")


_STEPS_SQL = [
    ("not rejected", "pol_stat_cd not in ('A','N','R')"),
    ("yearly", "pmt_mode = 12"),
    ("big", "tot_ape > 100000"),
    ("open", "pol_trmn_dt is null"),
]


def _steps():
    return [
        ("not rejected", ~c("pol_stat_cd").isin("A", "N", "R")),
        ("yearly", c("pmt_mode") == 12),
        ("big", c("tot_ape") > 100000),
        ("open", c("pol_trmn_dt").isNull()),
    ]


def _waterfall_sql(count: str) -> str:
    parts = []
    for i, (name, _) in enumerate(_STEPS_SQL):
        before = " and ".join(f"({s})" for _, s in _STEPS_SQL[:i]) or "true"
        now = " and ".join(f"({s})" for _, s in _STEPS_SQL[: i + 1])
        a, b = f"{count} filter (where {before})", f"{count} filter (where {now})"
        parts.append(f"select {i + 1} as step, '{name}' as condition, {a} - {b} as removed, {b} as remaining from policy")
    return " union all ".join(parts)


@query("waterfall", _waterfall_sql("count(*)"))
def _(t):
    return P.waterfall(t["policy"], _steps())


@query("waterfall_by_key", _waterfall_sql("count(distinct po_num)"))
def _(t):
    return P.waterfall(t["policy"], _steps(), "po_num")


# ---------------------------------------------------------------- joins


@query(
    "join_inner",
    "select pol_num, wa_code, tot_ape from policy join policy_agent using (pol_num)",
)
def _(t):
    return J.join_inner(t["policy"], t["policy_agent"], ["pol_num"]).select("pol_num", "wa_code", "tot_ape")


@query("join_left", "select pol_num, wa_code from policy left join policy_agent using (pol_num)")
def _(t):
    return J.join_left(t["policy"], t["policy_agent"], ["pol_num"]).select("pol_num", "wa_code")


@query(
    "star_join",
    """select pol_num, po_num, wa_code, lapse_score, p_1, mthly_incm from policy
       left join policy_agent using (pol_num) left join lapse using (pol_num) left join early_lapse using (pol_num)
       left join (select cli_num as po_num, mthly_incm from client) k using (po_num)""",
)
def _(t):
    owner = t["client"].select(c("cli_num").alias("po_num"), "mthly_incm")
    dims = [(t["policy_agent"], ["pol_num"]), (t["lapse"], ["pol_num"]), (t["early_lapse"], ["pol_num"]), (owner, ["po_num"])]
    return J.star_join(t["policy"], dims).select("pol_num", "po_num", "wa_code", "lapse_score", "p_1", "mthly_incm")


@query(
    "join_composite",
    f"""select pol_num, wa_code, {money('cvg_prem')} as prem from coverage join policy_agent using (pol_num, wa_code)
        group by pol_num, wa_code""",
)
def _(t):
    both = J.join_composite(t["coverage"], t["policy_agent"], ["pol_num", "wa_code"])
    return both.groupBy("pol_num", "wa_code").agg(M.total(c("cvg_prem")).alias("prem"))


@query(
    "join_named_keys",
    "select pol_num, cli_num, customer_segment from policy left join client on po_num = cli_num",
)
def _(t):
    return J.join_named_keys(t["policy"], t["client"], {"po_num": "cli_num"}).select("pol_num", "cli_num", "customer_segment")


@query(
    "join_roles",
    """select pol_num, w.tier as wa_tier, s.tier as sa_tier, s.loc_cd as sa_loc_cd, w.loc_cd as wa_loc_cd from policy_agent p
       left join agent w on p.wa_code = w.agt_code left join agent s on p.sa_code = s.agt_code""",
)
def _(t):
    roles = J.join_roles(t["policy_agent"], t["agent"], "agt_code", {"wa_code": "wa", "sa_code": "sa"}, ["tier", "loc_cd"])
    return roles.select("pol_num", "wa_tier", "sa_tier", "sa_loc_cd", "wa_loc_cd")


@query(
    "interval_join",
    f"""select c.plan_code, count(*) as n_pairs, {money('c.cvg_prem')} as prem, {money('h.nbv_margin')} as margin
        from coverage c join margin_history h on c.plan_code = h.plan_code
         and floor({months_between('c.cvg_eff_dt', 'h.effective_date')}) between 0 and 2 group by c.plan_code""",
)
def _(t):
    left = t["coverage"].select("plan_code", "cvg_eff_dt", "cvg_prem")
    pairs = J.interval_join(left, t["margin_history"], ["plan_code"], "cvg_eff_dt", "effective_date", 0, 2)
    return pairs.groupBy("plan_code").agg(
        F.count("*").alias("n_pairs"), M.total(c("cvg_prem")).alias("prem"), M.total(c("nbv_margin")).alias("margin")
    )


@query(
    "lookup_coalesce",
    """select plan_code, coalesce(nbv_margin_a, nbv_margin_b) as static_first,
       coalesce(h.latest, nbv_margin_a, nbv_margin_b) as dated_first
       from plan left join (select plan_code, max(nbv_margin) as latest from margin_history group by plan_code) h using (plan_code)""",
)
def _(t):
    latest = t["margin_history"].groupBy("plan_code").agg(F.max("nbv_margin").alias("latest"))
    both = t["plan"].join(latest, "plan_code", "left")
    return both.select(
        "plan_code",
        J.lookup_coalesce(c("nbv_margin_a"), c("nbv_margin_b")).alias("static_first"),
        J.lookup_coalesce(c("latest"), c("nbv_margin_a"), c("nbv_margin_b")).alias("dated_first"),
    )


@query("join_semi", "select cli_num, cur_age from client where cli_num in (select po_num from policy where pol_stat_cd = 'B')")
def _(t):
    lapsed = t["policy"].filter(c("pol_stat_cd") == "B")
    return J.join_semi(t["client"], lapsed, {"cli_num": "po_num"}).select("cli_num", "cur_age")


@query(
    "flag_exists",
    "select pol_num, case when pol_num in (select pol_num from claim where clm_stat_code = 'A') then 1 else 0 end as f_claim from policy",
)
def _(t):
    return J.flag_exists(t["policy"].select("pol_num"), t["claim"].filter(c("clm_stat_code") == "A"), "pol_num", "f_claim")


@query("join_broadcast", "select agt_code, city, region from agent join location using (loc_cd)")
def _(t):
    return J.join_broadcast(t["agent"], t["location"], ["loc_cd"]).select("agt_code", "city", "region")


@query(
    "merge_metrics",
    """select pol_num, coalesce(n_cvg, 0) as n_cvg, coalesce(n_app, 0) as n_app, coalesce(n_lapse, 0) as n_lapse
       from (select pol_num, count(*) as n_cvg from coverage where cvg_typ = 'R' group by pol_num) a
       full join (select pol_num, count(*) as n_app from claim where clm_stat_code = 'A' group by pol_num) b using (pol_num)
       full join (select pol_num, count(*) as n_lapse from lapse group by pol_num) d using (pol_num)""",
)
def _(t):
    a = t["coverage"].filter(c("cvg_typ") == "R").groupBy("pol_num").agg(F.count("*").alias("n_cvg"))
    b = t["claim"].filter(c("clm_stat_code") == "A").groupBy("pol_num").agg(F.count("*").alias("n_app"))
    d = t["lapse"].groupBy("pol_num").agg(F.count("*").alias("n_lapse"))
    return J.merge_metrics([a, b, d], "pol_num")


@query(
    "join_kpi_chain",
    """select wa_code, n_cvg, coalesce(n_rider, 0) as n_rider, coalesce(n_big, 0) as n_big
       from (select wa_code, count(*) as n_cvg from coverage group by wa_code) a
       left join (select wa_code, count(*) as n_rider from coverage where cvg_typ = 'R' and prem_dur > 40 group by wa_code) b using (wa_code)
       left join (select wa_code, count(*) as n_big from coverage where cvg_prem > 85000 group by wa_code) d using (wa_code)""",
)
def _(t):
    cov = t["coverage"]
    a = cov.groupBy("wa_code").agg(F.count("*").alias("n_cvg"))
    b = cov.filter((c("cvg_typ") == "R") & (c("prem_dur") > 40)).groupBy("wa_code").agg(F.count("*").alias("n_rider"))
    d = cov.filter(c("cvg_prem") > 85000).groupBy("wa_code").agg(F.count("*").alias("n_big"))
    return J.join_kpi_chain(a, [b, d], "wa_code")


@query(
    "join_latest",
    """select cli_num, pol_num, tot_ape from client join
       (select *, row_number() over (partition by po_num order by pol_eff_dt desc, pol_num) as rn from policy) p
       on cli_num = po_num and rn = 1""",
)
def _(t):
    newest = R.latest_per_key(t["policy"], ["po_num"], [("pol_eff_dt", "desc"), ("pol_num", "asc")])
    return J.join_named_keys(t["client"], newest, {"cli_num": "po_num"}, "inner").select("cli_num", "pol_num", "tot_ape")


# A person is known by one of three keys; owner and agent are the same if any key is.
_KEYS_SQL = """select {id} as id, 'id' as kind, id_num as k from {table} where id_num is not null
   union all select {id}, 'mail', per_nm || '/' || birth_dt || '/' || sex_code || '/' || email_addr from {table}
   union all select {id}, 'phone', per_nm || '/' || birth_dt || '/' || sex_code || '/' || mobl_phon_num from {table}"""
_IDENTITY_SQL = f"""select po_num, cast(count(agt_code) > 0 as int) as f_owner_is_agent
   from policy join client on po_num = cli_num left join policy_agent using (pol_num)
   left join (select distinct own.id as cli_num, seller.id as agt_code from ({_KEYS_SQL.format(id='cli_num', table='client')}) own
              join ({_KEYS_SQL.format(id='agt_code', table='agent')}) seller using (kind, k)) same
   on same.cli_num = po_num and agt_code = wa_code group by po_num"""


@query("identity_match", _IDENTITY_SQL)
def _(t):
    return J.identity_match(t["policy"].join(t["policy_agent"], "pol_num", "left"), t["client"], t["agent"])


@query(
    "map_by_key",
    "select clm_id, min(wa_code) as wa_code from claim left join (select pol_num, wa_code from coverage) k using (pol_num) group by clm_id",
)
def _(t):
    mapped = J.map_by_key(t["claim"].select("clm_id", "pol_num"), t["coverage"], "pol_num", "wa_code")
    return mapped.groupBy("clm_id").agg(F.min("wa_code").alias("wa_code"))


# ---------------------------------------------------------------- aggregations


@query(
    "group_agg",
    f"""select pol_stat_cd, count(*) as n, {money('tot_ape')} as sum_ape, {average('tot_ape')} as avg_ape,
        min(tot_ape) as min_ape, max(tot_ape) as max_ape, min(pol_num) as first_pol from policy group by pol_stat_cd""",
)
def _(t):
    ape = c("tot_ape")
    return t["policy"].groupBy("pol_stat_cd").agg(
        F.count("*").alias("n"),
        M.total(ape).alias("sum_ape"),
        M.mean(ape).alias("avg_ape"),
        F.min(ape).alias("min_ape"),
        F.max(ape).alias("max_ape"),
        F.min("pol_num").alias("first_pol"),
    )


def _offset_windows():
    return A.trailing_windows("mth_offset", "yr", int(SNAP[:4]))


def _with_offset(t):
    day = c("cvg_eff_dt")
    return t["coverage"].withColumns({"mth_offset": dates.month_offset(day, snap_day()), "yr": F.year(day)})


@query(
    "trailing_sums",
    "select wa_code, "
    + ", ".join(f"{money0(f'case when {w} then cvg_prem end')} as {n}_ape" for n, w in windows("cvg_eff_dt").items())
    + " from coverage group by wa_code",
)
def _(t):
    return A.trailing_sums(_with_offset(t), ["wa_code"], ["mth_offset", "yr"], _offset_windows(), {"ape": ("cvg_prem", 2)})


@query(
    "trailing_distinct",
    "select wa_code, "
    + ", ".join(
        f"count(distinct case when {w} then {col} end) as {n}_{short}"
        for short, col in (("pol", "pol_num"), ("plan", "plan_code"))
        for n, w in windows("cvg_eff_dt").items()
    )
    + f" from coverage where {' or '.join(f'({w})' for w in windows('cvg_eff_dt').values())} group by wa_code",
)
def _(t):
    families = {"pol_num": {"pol": "true"}, "plan_code": {"plan": "true"}}
    return A.trailing_distinct(_with_offset(t), "wa_code", _offset_windows(), families)


@query(
    "distinct_by_flag",
    """select po_num, count(distinct case when pol_stat_cd in ('1','3') then pol_num end) as inforce_pol,
       count(distinct case when pol_stat_cd = 'B' then pol_num end) as lapsed_pol,
       count(distinct case when pmt_mode = 12 then pol_num end) as annual_pol from policy group by po_num""",
)
def _(t):
    flags = {"inforce_pol": c("pol_stat_cd").isin("1", "3"), "lapsed_pol": c("pol_stat_cd") == "B", "annual_pol": c("pmt_mode") == 12}
    return A.distinct_by_flag(t["policy"], "po_num", "pol_num", flags)


@query(
    "count_by_category",
    "select loc_cd, "
    + ", ".join(f"cast(sum(case when tier = '{k}' then 1 else 0 end) as bigint) as n_{k.lower()}" for k in bands.TIER_RANK)
    + " from agent group by loc_cd",
)
def _(t):
    return A.count_by_category(t["agent"], "loc_cd", "tier", {k: f"n_{k.lower()}" for k in bands.TIER_RANK})


@query(
    "any_flag",
    "select po_num, max(case when pol_stat_cd in ('1','3') then 1 else 0 end) as f_inforce, max(case when pmt_mode = 12 then 1 else 0 end) as f_annual from policy group by po_num",
)
def _(t):
    return A.any_flag(t["policy"], "po_num", {"f_inforce": c("pol_stat_cd").isin("1", "3"), "f_annual": c("pmt_mode") == 12})


@query(
    "ratio_of_sums",
    f"""select plan_code, {money('cvg_prem * nbv_margin', 4)} / nullif({money('cvg_prem', 4)}, 0) as margin,
        {money('cvg_prem')} * min(prem_dur) as value from coverage group by plan_code""",
)
def _(t):
    prem = c("cvg_prem")
    return t["coverage"].groupBy("plan_code").agg(
        M.ratio_of_sums(prem * c("nbv_margin"), prem, 4).alias("margin"),
        (M.total(prem) * F.min("prem_dur")).alias("value"),
    )


@query(
    "case_over_agg",
    """select po_num, case when sum(case when dist_chnl_cd in ('01','02','*') then 1 else 0 end) >= 1 then 'Agency'
       when sum(case when dist_chnl_cd = '03' then 1 else 0 end) >= 1 then 'Bank' else 'Other' end as channel from policy group by po_num""",
)
def _(t):
    def seen(*codes):
        return F.sum(F.when(c("dist_chnl_cd").isin(*codes), 1).otherwise(0)) >= 1

    label = bands.first_match([(seen("01", "02", "*"), "Agency"), (seen("03"), "Bank")], "Other")
    return t["policy"].groupBy("po_num").agg(label.alias("channel"))


@query("group_having", "select po_num, count(*) as n_pol from policy group by po_num having count(*) > 10")
def _(t):
    return t["policy"].groupBy("po_num").agg(F.count("*").alias("n_pol")).filter(c("n_pol") > 10)


_SLOTS = ["sbw01", "sbw02", "sbw03", "sbw04"]


@query(
    "count_present",
    "select agt_code, cast(sum("
    + " + ".join(f"case when {s} is not null then 1 else 0 end" for s in _SLOTS)
    + ") as bigint) as n_slots from training group by agt_code having n_slots > 0",
)
def _(t):
    return A.count_present(t["training"], "agt_code", _SLOTS, "n_slots")


@query(
    "agg_of_agg",
    f"""select mth, cast(sum(cast(ape as decimal(18,2))) as double) / count(ape) as avg_ape
        from (select wa_code, strftime(cvg_eff_dt, '%Y-%m') as mth, {money('cvg_prem')} as ape from coverage group by 1, 2) q group by mth""",
)
def _(t):
    per = t["coverage"].groupBy("wa_code", dates.year_month(c("cvg_eff_dt")).alias("mth")).agg(M.total(c("cvg_prem")).alias("ape"))
    return per.groupBy("mth").agg(M.mean(c("ape")).alias("avg_ape"))


@query(
    "period_totals",
    f"select wa_code, year(cvg_eff_dt) as yr, cvg_typ, {money('cvg_prem')} as prem from coverage group by 1, 2, 3",
)
def _(t):
    return t["coverage"].groupBy("wa_code", F.year("cvg_eff_dt").alias("yr"), "cvg_typ").agg(M.total(c("cvg_prem")).alias("prem"))


@query(
    "pivot_first_n",
    """select po_num, max(case when rn = 1 then pol_num end) as pol_num_1, cast(max(case when rn = 1 then cast(trunc(tot_ape) as int) end) as int) as tot_ape_1,
       max(case when rn = 2 then pol_num end) as pol_num_2, cast(max(case when rn = 2 then cast(trunc(tot_ape) as int) end) as int) as tot_ape_2
       from (select *, row_number() over (partition by po_num order by pol_eff_dt, pol_num) as rn from policy) q where rn <= 2 group by po_num""",
)
def _(t):
    return A.pivot_first_n(
        t["policy"], "po_num", [("pol_eff_dt", "asc"), ("pol_num", "asc")], 2, ["pol_num", "tot_ape"], {"tot_ape": "int"}
    )


_SHARES = {"p1": 0.01, "p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def _percentile_sql(col: str) -> str:
    return ", ".join(f"round(quantile_cont({col}, {s}), 4) as {n}" for n, s in _SHARES.items())


@query(
    "percentiles",
    f"""select pol_stat_cd, {_percentile_sql('tot_ape')}, count(*) as n_rows, min(tot_ape) as min_value,
        max(tot_ape) as max_value, round({average('tot_ape')}, 4) as mean_value from policy group by pol_stat_cd""",
)
def _(t):
    out = O.percentiles(t["policy"], ["pol_stat_cd"], "tot_ape", _SHARES)
    return out.withColumns({n: F.round(n, 4) for n in _SHARES} | {"mean_value": F.round("mean_value", 4)})


@query(
    "quantile_cutoffs",
    " union all ".join(
        f"select '{m}' as measure, round(quantile_cont({m}, 0.75), 4) as high, round(quantile_cont({m}, 0.25), 4) as moderate from coverage"
        for m in ("cvg_prem", "prem_dur")
    ),
)
def _(t):
    cuts = A.quantile_cutoffs(t["coverage"], ["cvg_prem", "prem_dur"], {"high": 0.75, "moderate": 0.25})
    return cuts.withColumns({n: F.round(n, 4) for n in ("high", "moderate")})


@query(
    "profile",
    f"""select customer_segment, count(cli_num) as customers, {average('mthly_incm')} as mean_income, {average('cur_age')} as mean_age,
        {average('no_dpnd')} as mean_dependents, {money0('mthly_incm')} as sum_income, max(cur_age) as max_age, min(cur_age) as min_age,
        count(distinct case when sex_code = 'F' then cli_num end) as women,
        {average("case when sex_code = 'F' then mthly_incm end")} as mean_income_women from client group by customer_segment""",
)
def _(t):
    woman = "sex_code = 'F'"
    spec = [
        ("customers", "count", "cli_num", None, 0),
        ("mean_income", "mean", "mthly_incm", None, 2),
        ("mean_age", "mean", "cur_age", None, 2),
        ("mean_dependents", "mean", "no_dpnd", None, 2),
        ("sum_income", "sum", "mthly_incm", None, 2),
        ("max_age", "max", "cur_age", None, 0),
        ("min_age", "min", "cur_age", None, 0),
        ("women", "distinct", "cli_num", woman, 0),
        ("mean_income_women", "mean", "mthly_incm", woman, 2),
    ]
    return A.profile(t["client"], ["customer_segment"], spec)


@query(
    "profile_total",
    f"select count(cli_num) as customers, {average('mthly_incm')} as mean_income, {money0('mthly_incm')} as sum_income from client",
)
def _(t):
    spec = [
        ("customers", "count", "cli_num", None, 0),
        ("mean_income", "mean", "mthly_incm", None, 2),
        ("sum_income", "sum", "mthly_incm", None, 2),
    ]
    return A.profile_total(t["client"], spec)


@query(
    "crosstab_counts",
    "select pol_stat_cd, pmt_mode, dist_chnl_cd, count(distinct po_num) as owners from policy group by all",
)
def _(t):
    return A.crosstab_counts(t["policy"], ["pol_stat_cd", "pmt_mode", "dist_chnl_cd"], "owners", "po_num")


@query("value_counts", "select no_dpnd, count(*) as n from client group by no_dpnd order by no_dpnd nulls last")
def _(t):
    return A.value_counts(t["client"], "no_dpnd")


@query(
    "collect_per_key",
    """select po_num, string_agg(cast(pol_num as varchar), ',' order by rn) as top_pols from
       (select *, row_number() over (partition by po_num order by tot_ape desc, pol_num) as rn from policy) q where rn <= 3 group by po_num""",
)
def _(t):
    return A.collect_per_key(t["policy"], "po_num", [("tot_ape", "desc"), ("pol_num", "asc")], "pol_num", 3, "top_pols")


@query(
    "summary_stats",
    " union all ".join(
        f"""select '{m}' as measure, count({m}) as n, {average(m)} as mean_value, cast(min({m}) as double) as min_value,
            cast(max({m}) as double) as max_value, count(*) - count({m}) as n_missing from client"""
        for m in ("mthly_incm", "no_dpnd", "cur_age")
    ),
)
def _(t):
    return A.summary_stats(t["client"], ["mthly_incm", "no_dpnd", "cur_age"])


@query(
    "count_related",
    "select agt_code, tier, count(distinct po_num) as po_num_count from agent join policy_agent on agt_code = wa_code join policy using (pol_num) group by agt_code, tier",
)
def _(t):
    links = t["policy_agent"].join(t["policy"], "pol_num").select(c("wa_code").alias("agt_code"), "po_num")
    return A.count_related(t["agent"].select("agt_code", "tier"), links, "agt_code", "po_num", "po_num_count")


@query(
    "best_known_value",
    "select cli_num, coalesce(m.declared, k.mthly_incm) as income from client k left join (select po_num, max(tot_ape) / 12 as declared from policy where pmt_mode = 1 group by po_num) m on cli_num = po_num",
)
def _(t):
    declared = t["policy"].filter(c("pmt_mode") == 1).groupBy("po_num").agg((F.max("tot_ape") / 12).alias("declared"))
    both = J.join_named_keys(t["client"], declared, {"cli_num": "po_num"})
    return both.select("cli_num", F.coalesce("declared", "mthly_incm").alias("income"))


# ---------------------------------------------------------------- windows and ranks

_NEWEST = "row_number() over (partition by po_num order by pol_eff_dt desc, pol_num)"


@query("latest_per_key", f"select po_num, pol_num from (select *, {_NEWEST} as rn from policy) q where rn = 1")
def _(t):
    return R.latest_per_key(t["policy"], ["po_num"], [("pol_eff_dt", "desc"), ("pol_num", "asc")]).select("po_num", "pol_num")


@query(
    "first_per_key",
    "select po_num, pol_num from (select *, row_number() over (partition by po_num order by pol_eff_dt, pol_num) as rn from policy) q where rn = 1",
)
def _(t):
    return R.first_per_key(t["policy"], ["po_num"], [("pol_eff_dt", "asc"), ("pol_num", "asc")]).select("po_num", "pol_num")


@query(
    "asof_rate",
    f"""select xchng_rate as ex_rate from rate where rate_typ = 'U' and ccy = '78' and fr_eff_dt <= date '{SNAP}'
        qualify row_number() over (order by fr_eff_dt desc) = 1""",
)
def _(t):
    return R.asof_rate(t["rate"], "U", "78", snap_day())


@query("ntile_global", "select pol_num, ntile(10) over (order by tot_ape desc, pol_num) as decile from policy")
def _(t):
    return O.ntile_global(t["policy"].select("pol_num", "tot_ape"), 10, [("tot_ape", "desc"), ("pol_num", "asc")], "decile").select("pol_num", "decile")


@query(
    "ntile_multi",
    """select cli_num, ntile(10) over (order by mthly_incm desc nulls last, cli_num) as income_decile,
       ntile(10) over (order by cur_age desc, cli_num) as age_decile from client where customer_segment <> 'BUILDING'""",
)
def _(t):
    some = t["client"].filter(c("customer_segment") != "BUILDING").select("cli_num", "mthly_incm", "cur_age")
    orders = {
        "income_decile": [("mthly_incm", "desc"), ("cli_num", "asc")],
        "age_decile": [("cur_age", "desc"), ("cli_num", "asc")],
    }
    return O.ntile_multi(some, 10, orders).select("cli_num", "income_decile", "age_decile")


@query(
    "ntile_within",
    "select cli_num, ntile(5) over (order by mthly_incm nulls last, cli_num) as quintile from client where customer_segment = 'BUILDING'",
)
def _(t):
    order = [("mthly_incm", "asc"), ("cli_num", "asc")]
    return O.ntile_within(t["client"], c("customer_segment") == "BUILDING", 5, order, "quintile").select("cli_num", "quintile")


@query(
    "running_min",
    """select clm_id, clm_recv_dt, clm_prvd_amt, pol_num, min(clm_prvd_amt) over (partition by clm_code order by clm_recv_dt, clm_id, clm_prvd_amt
       rows between unbounded preceding and current row) as low_so_far from claim""",
    text=["clm_recv_dt"],
)
def _(t):
    some = t["claim"].select("clm_code", "clm_id", "clm_recv_dt", "clm_prvd_amt", "pol_num")
    order = [("clm_recv_dt", "asc"), ("clm_id", "asc"), ("clm_prvd_amt", "asc")]
    return O.running_min(some, ["clm_code"], order, "clm_prvd_amt", "low_so_far").drop("clm_code")


@query(
    "carry_latest",
    """select pol_num, clm_prvd_amt, first(clm_recv_dt) over w as lst_dt, first(clm_prvd_amt) over w as lst_amt from claim
       window w as (partition by pol_num order by clm_recv_dt desc, clm_prvd_amt desc)""",
    text=["lst_dt"],
)
def _(t):
    carried = R.carry_latest(t["claim"], "pol_num", "clm_recv_dt", "clm_prvd_amt", "lst_dt", "lst_amt")
    return carried.select("pol_num", "clm_prvd_amt", "lst_dt", "lst_amt")


@query(
    "first_and_repeat",
    f"""select login_id, cast(min(date_time) as date) as reg_dt, cast(max(case when rn > 1 and date_time <= timestamp '2024-01-20' then date_time end) as date) as lst_login_dt
        from (select *, row_number() over (partition by login_id order by date_time, event_id) as rn from hit) q group by login_id""",
    text=["reg_dt", "lst_login_dt"],
)
def _(t):
    out = R.first_and_repeat(t["hit"], "login_id", "date_time", F.lit("2024-01-20").cast("timestamp_ntz"), "reg_dt", "lst_login_dt")
    return out.select("login_id", F.to_date("reg_dt").alias("reg_dt"), F.to_date("lst_login_dt").alias("lst_login_dt"))


@query(
    "average_rank",
    """select cli_num, cast(floor(rank() over (order by cur_age desc) + (count(*) over (partition by cur_age) - 1) / 2.0e0) as int) as age_rank from client""",
)
def _(t):
    return O.average_rank(t["client"].select("cli_num", "cur_age"), "cur_age", "age_rank").select("cli_num", "age_rank")


@query("first_non_null", "select loc_cd, coalesce(manager_name_0, manager_name_1, manager_name_2) as manager from location")
def _(t):
    cols = ["manager_name_0", "manager_name_1", "manager_name_2"]
    return t["location"].select("loc_cd", R.first_non_null(cols).alias("manager"))


# ---------------------------------------------------------------- sort, limit, top lists


@query("order_result", "select agt_code, tier, acum_bal from agent order by tier, acum_bal desc, agt_code")
def _(t):
    return t["agent"].select("agt_code", "tier", "acum_bal").orderBy("tier", F.desc("acum_bal"), "agt_code")


@query("limit_rows", "select pol_num, tot_ape from policy order by tot_ape, pol_num limit 50")
def _(t):
    return R.top_n(t["policy"].select("pol_num", "tot_ape"), [("tot_ape", "asc"), ("pol_num", "asc")], 50)


@query(
    "top_n_profile",
    " union all ".join(
        f"""select {n} as top_n, count(*) as customers, {average('mthly_incm')} as mean_income, {average('cur_age')} as mean_age
            from (select * from client where mthly_incm is not null order by mthly_incm desc, cli_num limit {n}) q"""
        for n in (100, 250, 500)
    ),
)
def _(t):
    known = t["client"].filter(c("mthly_incm").isNotNull())
    spec = [("customers", "count", "cli_num", None, 0), ("mean_income", "mean", "mthly_incm", None, 2), ("mean_age", "mean", "cur_age", None, 2)]
    order = [("mthly_incm", "desc"), ("cli_num", "asc")]
    parts = [A.profile_total(R.top_n(known, order, n), spec).select(F.lit(n).alias("top_n"), "*") for n in (100, 250, 500)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "top_k_per_key",
    "select po_num, pol_num, tot_ape from (select *, row_number() over (partition by po_num order by tot_ape desc, pol_num) as rn from policy) q where rn <= 3",
)
def _(t):
    return R.top_k_per_key(t["policy"], ["po_num"], [("tot_ape", "desc"), ("pol_num", "asc")], 3).select("po_num", "pol_num", "tot_ape")


@query(
    "top_categories",
    """select case when city_cd in (select city_cd from client group by city_cd order by count(*) desc, city_cd limit 15)
       then cast(city_cd as varchar) else 'Other' end as city_grouped, count(*) as n from client group by 1""",
)
def _(t):
    top = R.top_categories(t["client"].select("city_cd"), "city_cd", 15)
    return top.select(c("city_cd_grouped").alias("city_grouped")).groupBy("city_grouped").agg(F.count("*").alias("n"))


@query(
    "rare_to_other",
    """select case when n < 60 then 'Others' else grp end as plan_group, cast(sum(n) as bigint) as n from
       (select plan_grp as grp, count(*) as n from plan group by plan_grp) q group by 1""",
)
def _(t):
    out = R.rare_to_other(t["plan"].select("plan_grp"), "plan_grp", 60)
    return out.groupBy(c("plan_grp_grouped").alias("plan_group")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sets


@query(
    "union_scores",
    "select po_num, least(health_base, inv_base, riders) as min_score from score union all select pol_num, least(p_1, decile / 10.0e0) from early_lapse",
)
def _(t):
    early = t["early_lapse"].select(c("pol_num").alias("po_num"), "p_1", (c("decile") / 10).alias("d"))
    return U.union_scores([(t["score"], ["health_base", "inv_base", "riders"]), (early, ["p_1", "d"])], "po_num", "min_score")


@query("distinct_rows", "select distinct pol_num, wa_code from coverage")
def _(t):
    return U.distinct_rows(t["coverage"], ["pol_num", "wa_code"])


@query("duplicate_keys", "select clm_id, count(*) as n_rows from claim group by clm_id having count(*) > 1")
def _(t):
    return U.duplicate_keys(t["claim"], ["clm_id"])


@query(
    "duplicate_audit",
    "select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, count(case when n > 1 then 1 end) as n_repeated from (select count(*) as n from claim group by clm_id) q",
)
def _(t):
    return U.duplicate_audit(t["claim"], ["clm_id"])


# ---------------------------------------------------------------- scalar expressions


@query(
    "month_end",
    """select pol_num, last_day(pol_eff_dt - interval 1 month) as m0, last_day(pol_eff_dt - interval 4 month) as m3,
       last_day(pol_eff_dt - interval 13 month) as m12, strftime(last_day(pol_eff_dt - interval 1 month), '%Y%m') as m0_short from policy""",
    text=["m0", "m3", "m12"],
)
def _(t):
    day = c("pol_eff_dt")
    return t["policy"].select(
        "pol_num",
        dates.month_end(day).alias("m0"),
        dates.month_end(day, 3).alias("m3"),
        dates.month_end(day, 12).alias("m12"),
        F.date_format(dates.month_end(day), "yyyyMM").alias("m0_short"),
    )


@query("month_offset", f"select pol_num, {offset('pol_eff_dt')} as mth from policy")
def _(t):
    return t["policy"].select("pol_num", dates.month_offset(c("pol_eff_dt"), snap_day()).alias("mth"))


_MB = months_between(f"date '{SNAP}'", "pol_eff_dt")


@query(
    "months_apart",
    f"""select pol_num, {_MB} as months, cast(trunc({_MB}) as int) as whole, {_MB} < 3 as in_3m, {_MB} < 12 as in_12m,
        cast(trunc({_MB} + 1) as int) as ordinal from policy""",
)
def _(t):
    gap = dates.months_apart(snap_day(), c("pol_eff_dt"))
    return t["policy"].select(
        "pol_num",
        gap.alias("months"),
        dates.whole_months(snap_day(), c("pol_eff_dt")).alias("whole"),
        (gap < 3).alias("in_3m"),
        (gap < 12).alias("in_12m"),
        (gap + 1).cast("int").alias("ordinal"),
    )


@query(
    "elapsed",
    f"""select pol_num, date '{SNAP}' - pol_eff_dt as days, cast(trunc((date '{SNAP}' - pol_eff_dt) / 7.0e0) as int) as weeks,
        (date '{SNAP}' - pol_eff_dt) / 30.0e0 as months30, (date '{SNAP}' - pol_eff_dt) / 365.25e0 as years from policy""",
)
def _(t):
    day = c("pol_eff_dt")
    return t["policy"].select(
        "pol_num",
        F.datediff(snap_day(), day).alias("days"),
        dates.elapsed(snap_day(), day, 7.0).cast("int").alias("weeks"),
        dates.elapsed(snap_day(), day, 30.0).alias("months30"),
        dates.elapsed(snap_day(), day, 365.25).alias("years"),
    )


@query(
    "previous_due",
    "select pol_num, cast(pd_to_dt - to_months(pmt_mode) as date) as prev_due from policy",
    text=["prev_due"],
)
def _(t):
    return t["policy"].select("pol_num", dates.previous_due(c("pmt_mode"), c("pd_to_dt")).alias("prev_due"))


@query(
    "date_parts",
    "select pol_num, year(pol_eff_dt) as yr, month(pol_eff_dt) as mth, strftime(pol_eff_dt, '%Y-%m') as ym, strftime(pol_eff_dt, '%d/%m/%Y') as dmy from policy",
)
def _(t):
    day = c("pol_eff_dt")
    return t["policy"].select(
        "pol_num", F.year(day).alias("yr"), F.month(day).alias("mth"), dates.year_month(day).alias("ym"), F.date_format(day, "dd/MM/yyyy").alias("dmy")
    )


@query(
    "lagged_quarter",
    """select pol_num, case when month(pol_eff_dt) <= 3 then cast(year(pol_eff_dt) - 1 as varchar) || ' Q3' when month(pol_eff_dt) <= 6 then cast(year(pol_eff_dt) - 1 as varchar) || ' Q4'
       when month(pol_eff_dt) <= 9 then cast(year(pol_eff_dt) as varchar) || ' Q1' else cast(year(pol_eff_dt) as varchar) || ' Q2' end as qtr from policy""",
)
def _(t):
    return t["policy"].select("pol_num", dates.lagged_quarter(c("pol_eff_dt")).alias("qtr"))


@query(
    "parse_event_date",
    "select event_id, cast(date_time as date) as login_dt, last_day(cast(date_time as date) - interval 1 month) as cutoff from hit",
    text=["login_dt", "cutoff"],
)
def _(t):
    stamp = t["hit"].select("event_id", c("date_time").cast("string").alias("stamp"))
    day = dates.parse_event_date(F.substring("stamp", 1, 10))
    return stamp.select("event_id", day.alias("login_dt"), dates.previous_month_end(day).alias("cutoff"))


@query(
    "case_band",
    """select cli_num, case when mthly_incm >= 8000 then 'A' when mthly_incm >= 4000 and mthly_incm < 8000 then case when cur_age > 40 then 'B1' else 'B2' end
       when mthly_incm < 4000 then 'C' else 'Null' end as cls from client""",
)
def _(t):
    inc = c("mthly_incm")
    inner = F.when(c("cur_age") > 40, "B1").otherwise("B2")
    return t["client"].select(
        "cli_num", F.when(inc >= 8000, "A").when((inc >= 4000) & (inc < 8000), inner).when(inc < 4000, "C").otherwise("Null").alias("cls")
    )


@query(
    "map_codes",
    "select agt_code, case tier "
    + " ".join(f"when '{k}' then {v}" for k, v in bands.TIER_RANK.items())
    + " end as tier_rank, case comp_prvd_num when '01' then 'Agent' when '04' then 'Collector' else 'Other' end as provider from agent",
)
def _(t):
    return t["agent"].select(
        "agt_code",
        bands.map_codes(c("tier"), bands.TIER_RANK).alias("tier_rank"),
        bands.map_codes(c("comp_prvd_num"), {"01": "Agent", "04": "Collector"}, "Other").alias("provider"),
    )


@query(
    "indicator_flags",
    """select pol_num, case when lst_pmt_mthd = 'CHEQUE' then 1 else 0 end as f_cheque, case when lst_pmt_mthd = 'CASH' then 1 else 0 end as f_cash,
       case when pol_trmn_dt > date '2000-01-01' then 1 else 0 end as f_ended from policy""",
)
def _(t):
    return t["policy"].select(
        "pol_num",
        bands.flag(c("lst_pmt_mthd") == "CHEQUE").alias("f_cheque"),
        bands.flag(c("lst_pmt_mthd") == "CASH").alias("f_cash"),
        bands.flag(c("pol_trmn_dt") > F.to_date(F.lit("2000-01-01"))).alias("f_ended"),
    )


@query(
    "band",
    """select cli_num, case when no_dpnd >= 0 and no_dpnd <= 0.1 then '0' when no_dpnd > 0.1 and no_dpnd <= 1 then '1'
       when no_dpnd > 1 and no_dpnd <= 2 then '2' when no_dpnd > 2 then '3+' end as dpnd_cat from client""",
)
def _(t):
    cat = bands.band(c("no_dpnd"), [0, 0.1, 1, 2, bands.INF], ["0", "1", "2", "3+"])
    return t["client"].select("cli_num", cat.alias("dpnd_cat"))


@query(
    "first_match",
    "select cli_num, case when cur_age > 60 then 'senior' when no_dpnd > 0 then 'family' when mthly_incm > 5000 then 'earner' else 'other' end as grp from client",
)
def _(t):
    rules = [(c("cur_age") > 60, "senior"), (c("no_dpnd") > 0, "family"), (c("mthly_incm") > 5000, "earner")]
    return t["client"].select("cli_num", bands.first_match(rules, "other").alias("grp"))


@query(
    "coalesce_values",
    "select pol_num, coalesce(pol_trmn_dt, date '2001-06-30') as end_dt, coalesce(lapse_score, p_1, 0.0e0) as lapse from policy left join lapse using (pol_num) left join early_lapse using (pol_num)",
    text=["end_dt"],
)
def _(t):
    both = J.star_join(t["policy"], [(t["lapse"], ["pol_num"]), (t["early_lapse"], ["pol_num"])])
    return both.select("pol_num", F.coalesce("pol_trmn_dt", snap_day()).alias("end_dt"), F.coalesce("lapse_score", "p_1", F.lit(0.0)).alias("lapse"))


@query(
    "cap",
    """select cli_num, case when mthly_incm is not null then least(greatest(mthly_incm, 864), 5000) end as capped,
       least(mthly_incm, cast(no_dpnd as double)) as low, greatest(mthly_incm, cast(no_dpnd as double)) as high from client""",
)
def _(t):
    return t["client"].select(
        "cli_num",
        bands.cap(c("mthly_incm"), 864.0, 5000.0).alias("capped"),
        F.least("mthly_incm", c("no_dpnd").cast("double")).alias("low"),
        F.greatest("mthly_incm", c("no_dpnd").cast("double")).alias("high"),
    )


@query(
    "safe_ratio",
    "select cli_num, mthly_incm / nullif(no_dpnd, 0) as per_head, coalesce(mthly_incm / nullif(no_dpnd, 0), 1) as per_head_or_1 from client",
)
def _(t):
    a, b = c("mthly_incm"), c("no_dpnd")
    return t["client"].select("cli_num", M.safe_ratio(a, b).alias("per_head"), M.safe_ratio(a, b, 1).alias("per_head_or_1"))


@query("money_convert", "select pol_num, cast(cast(tot_ape / 23036.0e0 * 1000.0e0 as decimal(18,2)) as double) as ape_usd, round(tot_ape / 7.0e0, 2) as ape_7 from policy")
def _(t):
    return t["policy"].select("pol_num", M.money_convert(c("tot_ape"), F.lit(23036), 1000).alias("ape_usd"), F.round(c("tot_ape") / 7.0, 2).alias("ape_7"))


@query("annualise", "select pol_num, tot_ape * 12.0e0 / pmt_mode as yearly from policy")
def _(t):
    return t["policy"].select("pol_num", M.annualise(c("tot_ape"), c("pmt_mode")).alias("yearly"))


@query(
    "text_ops",
    """select agt_code, agt_code || '-' || agt_nm as full_nm, substr(agt_nm, 2) as cut, length(agt_nm) as len, concat_ws('_', bank_loc, tier) as mix,
       cast(no_sbw_completed * 9 // 12 as varchar) || 'y ' || cast(no_sbw_completed * 9 % 12 as varchar) || 'm' as ym from agent""",
)
def _(t):
    return t["agent"].select(
        "agt_code",
        F.concat(c("agt_code").cast("string"), F.lit("-"), c("agt_nm")).alias("full_nm"),
        text.drop_first(c("agt_nm")).alias("cut"),
        F.length("agt_nm").alias("len"),
        F.concat_ws("_", "bank_loc", "tier").alias("mix"),
        text.years_months(c("no_sbw_completed") * 9).alias("ym"),
    )


_FOUR = ["health_base", "inv_base", "health_rider", "riders"]


@query(
    "argmax_columns",
    "select po_num, case "
    + " ".join(f"when {m} = greatest({', '.join(_FOUR)}) then '{m}'" for m in _FOUR)
    + " end as best, case when riders > 0.1 then '*' else '' end as mark from score",
)
def _(t):
    return t["score"].select("po_num", bands.argmax_columns(_FOUR).alias("best"), F.when(c("riders") > 0.1, "*").otherwise("").alias("mark"))


@query("gap_to_target", "select pol_num, greatest(200000.0e0 - coalesce(ape, 0), 0) as gap from (select pol_num, case when pmt_mode = 12 then tot_ape end as ape from policy) q")
def _(t):
    ape = F.when(c("pmt_mode") == 12, c("tot_ape"))
    return t["policy"].select("pol_num", M.gap_to_target(F.lit(200000.0), ape).alias("gap"))


@query("inflate", "select cli_num, mthly_incm * (1.0e0 + cur_age / 10.0e0 * 0.0298e0) as adj from client")
def _(t):
    return t["client"].select("cli_num", M.inflate(c("mthly_incm"), c("cur_age") / 10.0).alias("adj"))


@query(
    "sample_rows",
    "select cli_num from client where cast('0x' || substr(md5('123:' || cli_num), 1, 5) as int) < 0.3 * 1048576",
)
def _(t):
    from tierline.plans.cluster import sample_rows

    return sample_rows(t["client"], "cli_num", 0.3, 123).select("cli_num")


# ---------------------------------------------------------------- function surface

_DAYS = "(pol_trmn_dt - pol_eff_dt)"
ADJUSTED_SQL = """coalesce(case when {single} then case when {days} is null or {days} <= 21 then 0.0e0 else {prem} * 0.1e0 end
  when {days} is null then {ape} when {days} <= 21 then 0.0e0 when {days} >= 365 then {ape}
  when {mode} = 12 then {ape} when {mode} = 1 then {prem} * (floor({days} / 31.0e0) + 1) when {mode} = 3 then {prem} * (floor({days} / 92.0e0) + 1)
  when {mode} = 6 then {prem} * (floor({days} / 183.0e0) + 1) else 0.0e0 end, 0.0e0)"""


@query(
    "adjusted_ape",
    "select pol_num, "
    + ADJUSTED_SQL.format(single="sngl_prem_ind = 'Y'", days=_DAYS, prem="tot_ape", ape="(tot_ape * 12.0e0 / pmt_mode)", mode="pmt_mode")
    + " as adj from policy join policy_plan using (pol_num) join plan using (plan_code)",
)
def _(t):
    both = t["policy"].join(t["policy_plan"], "pol_num").join(t["plan"], "plan_code")
    adj = M.adjusted_ape(
        F.datediff("pol_trmn_dt", "pol_eff_dt"), c("pmt_mode"), c("tot_ape"), M.annualise(c("tot_ape"), c("pmt_mode")), c("sngl_prem_ind") == "Y"
    )
    return both.select("pol_num", adj.alias("adj"))


@query(
    "relation_label",
    "select rel_to_insrd, case rel_to_insrd when '01' then 'Self' when '02' then 'Spouse' when '03' then 'Child' when '51' then 'Parent' else 'Others' end as label, count(*) as n from insured group by 1, 2",
)
def _(t):
    label = bands.relation_label(c("rel_to_insrd")).alias("label")
    return t["insured"].groupBy("rel_to_insrd", label).agg(F.count("*").alias("n"))


RELATION_SQL = """case when {same} = 1 or {gap} is null then 'self' when {gap} between 18 and 40 then 'child' when {gap} > 40 then 'others'
  when {gap} < -17 then 'parent' when {g1} <> {g2} then 'spouse' else 'others' end"""


@query(
    "infer_relation",
    f"""select rel, count(*) as n from (select {RELATION_SQL.format(same='case when i.po_num = i.cli_num then 1 else 0 end', gap='(o.cur_age - p.cur_age)', g1='o.sex_code', g2='p.sex_code')} as rel
        from insured i left join client o on i.po_num = o.cli_num left join client p on i.cli_num = p.cli_num) q group by rel""",
)
def _(t):
    people = t["client"].select("cli_num", "cur_age", "sex_code")
    both = J.join_roles(t["insured"], people, "cli_num", {"po_num": "po", "cli_num": "in"}, ["cur_age", "sex_code"])
    rel = bands.infer_relation(
        bands.flag(c("po_num") == c("cli_num")), c("po_cur_age") - c("in_cur_age"), c("po_sex_code"), c("in_sex_code")
    )
    return both.groupBy(rel.alias("rel")).agg(F.count("*").alias("n"))


@query(
    "composition",
    """select case when cur_age >= 0 and cur_age <= 25 then '<=25' when cur_age > 25 and cur_age <= 35 then '26-35' when cur_age > 35 and cur_age <= 55 then '36-55'
       when cur_age > 55 then '55+' end as age_cat, count(*) as n from client group by 1""",
)
def _(t):
    return A.composition(t["client"], bands.band(c("cur_age"), [0, 25, 35, 55, bands.INF], ["<=25", "26-35", "36-55", "55+"]), "age_cat")
