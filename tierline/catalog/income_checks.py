"""Queries on in-force customers by income and the SQL they must equal."""

from __future__ import annotations

from tierline.catalog.base import SNAP, average, derived, money, money0, offset, query
from tierline.catalog.customer_checks import client_level, rate
from tierline.plans import income as I
from tierline.sources.sink import stage, stage_last


def frame(t):
    return I.income_frame(stage_last(client_level(t), "client_level", ["owners"]))


_GAP = "case when adj_mthly_incm > 0 then f_with_dependent * (least(adj_mthly_incm, 20000.0e0) * 120 - coalesce({face}, 0.0e0)) end"
derived(
    "income_deciles",
    """select *, case when adj_mthly_incm < 43 then 43.0e0 when mthly_incm >= 20000 then 20000.0e0 else adj_mthly_incm end as mthly_incm_capped,
       ntile(10) over (order by adj_mthly_incm desc nulls last, po_num) as income_decile, ntile(10) over (order by cli_ltv_mod desc nulls last, po_num) as ltv_decile
       from client_level where inforce_ind = 1""",
)
derived(
    "income_gap",
    f"""select *, {_GAP.format(face='protection_fa')} as protection_gap_v2, {_GAP.format(face='tot_face_amt_usd')} as protection_gap_all,
        case when adj_mthly_incm > 0 then least(adj_mthly_incm, 20000.0e0) end as mthly_incm_99,
        case when adj_mthly_incm > 0 then least(adj_mthly_incm, 20000.0e0) * 12 - coverage_ape end as wallet_rem
        from (select *, case when f_dependent_ind is not null then 1 end as f_with_dependent from income_deciles) q""",
)
derived(
    "income_frame",
    """select *, case vip_income_class when 'A. > 10K' then '1 VIP' when 'B. 7-10K' then '1 VIP' when 'C. 5-7K' then '1 VIP' when 'D. 3-5K' then '2 High Income'
         when 'E. 2-3K' then '3 Mid Income' when 'F. 1.5-2K' then '3 Mid Income' when 'G. 500-1.5K' then '4 Low Income' when 'H. <500' then '5 Bottom of Pyramid'
         else '6 No/Missing Income' end as income_segment from (
       select *, case when mthly_incm_99 >= 1717 then 'A > 1717' when mthly_incm_99 >= 1288 then 'B > 1288-1717' when mthly_incm_99 >= 858 then 'C > 858-1288'
         when mthly_incm_99 >= 644 then 'D > 644-858' when mthly_incm_99 >= 429 then 'E > 429-644' when mthly_incm_99 < 429 then 'F <429' else 'G Null' end as local_income_class,
       case when adj_mthly_incm > 10000 then 'A. > 10K' when adj_mthly_incm > 7000 then 'B. 7-10K' when adj_mthly_incm > 5000 then 'C. 5-7K' when adj_mthly_incm > 3000 then 'D. 3-5K'
         when adj_mthly_incm > 2000 then 'E. 2-3K' when adj_mthly_incm > 1500 then 'F. 1.5-2K' when adj_mthly_incm >= 500 then 'G. 500-1.5K' when adj_mthly_incm < 500 then 'H. <500'
         else 'I. NaN' end as vip_income_class from income_gap) q""",
)


@query("income_deciles", "select po_num, income_decile, ltv_decile, mthly_incm_capped from income_deciles")
def _(t):
    level = stage_last(client_level(t), "client_level", ["owners"])
    return I.income_deciles(level).select("po_num", "income_decile", "ltv_decile", "mthly_incm_capped")


@query("protection_gap", "select po_num, f_with_dependent, mthly_incm_99, protection_gap_v2, protection_gap_all, wallet_rem from income_gap")
def _(t):
    live = client_level(t, cut=False).filter("inforce_ind = 1")
    return I.protection_gap(live).select("po_num", "f_with_dependent", "mthly_incm_99", "protection_gap_v2", "protection_gap_all", "wallet_rem")


@query("income_class_pyramid", "select income_decile, local_income_class, count(*) as n from income_frame group by 1, 2")
def _(t):
    return I.income_class_pyramid(frame(t))


@query(
    "income_segments",
    f"""select *, mean_ape / nullif(mean_income * (12 * 0.10e0), 0) as wallet_share from (select income_segment, count(po_num) as customers, {average('unassigned_ind')} as share_unassigned,
        {average('adj_mthly_incm', 4)} as mean_income, {average('cli_ltv_mod', 4)} as mean_cltv, {average('protection_fa_all', 4)} as mean_protection_fa_all,
        {average('protection_gap_all', 4)} as mean_protection_gap_all, {average('coverage_ape', 4)} as mean_ape from income_frame group by 1) q""",
)
def _(t):
    return I.income_segments(frame(t))


def spec_sql(spec) -> str:
    out = []
    for name, fn, col, cond, scale in spec:
        value = f"case when {cond} then {col} end" if cond else col
        text = {
            "count": f"count({value})",
            "sum": money0(value, scale),
            "mean": average(value, scale),
        }[fn]
        out.append(f"{text} as {name}")
    return ", ".join(out)


_PROFILE = spec_sql(I.PROFILE)


@query("segment_profiles", f"select income_segment, {_PROFILE} from income_frame group by 1")
def _(t):
    return I.segment_profiles(frame(t))


@query("decile_profiles", f"select ltv_decile, {_PROFILE} from income_frame group by 1")
def _(t):
    return I.segment_profiles(frame(t), ["ltv_decile"])


derived(
    "vip_frame",
    "select *, ntile(10) over (order by adj_mthly_incm desc nulls last, po_num) as vip_decile from income_frame where income_segment = '1 VIP'",
)


@query("vip_decile_profiles", f"select vip_decile, {_PROFILE} from vip_frame group by 1")
def _(t):
    return I.segment_profiles(I.vip_only(stage(frame(t), "income")), ["vip_decile"])


@query("subset_profile_total", f"select {_PROFILE} from income_frame where f_with_dependent = 1")
def _(t):
    return I.agg.profile_total(frame(t).filter("f_with_dependent = 1"), I.PROFILE)


@query(
    "top_n_profiles",
    " union all ".join(
        f"select {n} as top_n, {_PROFILE} from (select * from vip_frame order by adj_mthly_incm desc nulls last, po_num limit {n}) t{n}" for n in (100, 250, 500)
    ),
)
def _(t):
    return I.top_n_profiles(stage(frame(t), "income"))


_PROTECTION = spec_sql(I.PROTECTION)


@query("protection_summary", f"select income_segment, {_PROTECTION} from income_frame where f_with_dependent = 1 group by 1")
def _(t):
    return I.protection_summary(frame(t))


@query("protection_of_unassigned", f"select ltv_decile, {_PROTECTION} from income_frame where inforce_ind = 1 and unassigned_ind = 1 group by 1")
def _(t):
    return I.protection_of_unassigned(frame(t))


_BASE = "inforce_ind = 1 and unassigned_ind = 1 and ltv_decile < 4 and mthly_incm > 500"


@query(
    "use_case_targets",
    f"""select po_num, 1 as use_case from income_frame where {_BASE} and multi_prod = 0 and f_1st_investment = 1 and min_prem_dur > 5 and client_tenure > 0.58333
        union all select po_num, 2 from income_frame where {_BASE} and f_mat_0_12m = 1 and multi_prod = 0 and f_with_dependent = 1
        union all select po_num, 3 from income_frame where {_BASE} and protection_gap_v2 > 50000 and client_tenure > 1 and f_with_dependent = 1 and f_term_pol = 0 and f_whole_pol = 0""",
)
def _(t):
    return I.use_case_targets(frame(t))


@query("use_case_counts", "select income_segment, count(po_num) as customers from income_frame where unassigned_ind = 1 and ltv_decile < 4 group by 1")
def _(t):
    return I.use_case_counts(frame(t))


@query(
    "lead_conversion",
    f"""select income_segment, count(distinct case when l.n > 0 then f.po_num end) as lead_count, count(distinct case when s.n > 0 then f.po_num end) as converted_leads,
        coalesce(cast(sum(s.n) as double), 0.0e0) as conversion, {money0('s.ape / usd.r', 4)} as conversion_ape, {money0('s.nbv / usd.r', 4)} as conversion_nbv
        from income_frame f join usd on true left join (select tgt_cust_id, count(*) as n from campaign group by 1) l on l.tgt_cust_id = f.po_num
        left join (select p.po_num, count(*) as n, {money('p.tot_ape')} as ape, {money('p.tot_ape * m.nbv_margin_agency', 4)} as nbv from policy p
                   left join policy_plan using (pol_num) left join plan_margin m using (plan_code)
                   where {offset('p.pol_eff_dt')} between -6 and -1 and p.pol_eff_dt >= (select min(g.lead_dt) from campaign g where g.tgt_cust_id = p.po_num)
                   group by p.po_num) s on s.po_num = f.po_num group by income_segment""",
)
def _(t):
    return I.lead_conversion(frame(t))
