"""Queries on agents beside their customers and the SQL they must equal."""

from __future__ import annotations

from tierline.catalog.base import SNAP, derived, money, query
from tierline.catalog.customer_checks import LONG_YEARS, PRODUCTS, UNIT, client_level, rate
from tierline.catalog.income_checks import spec_sql
from tierline.catalog.sales_checks import _fact
from tierline.operators import aggregates as agg
from tierline.plans import activation as X
from tierline.plans import agents as S
from tierline.plans import customers as K
from tierline.sources.sink import stage, stage_last

APE_UNIT, MIN_BRANCH = 1000.0, 3
MIX_BOUNDS = [46000, 69000, 92000, 138000, 184000]


def kpis(t):
    return stage_last(S.agent_kpis(_fact(t), SNAP), "kpis", ["fact"])


def activation(t):
    return X.agent_activation(t, kpis(t), SNAP, APE_UNIT)


def target(t):
    """In-scope agents; the customer side needs only whether an owner is an agency customer."""
    level = client_level(t, cut=False)
    return stage_last(X.agent_target(t, activation(t), X.in_scope_customers(level)), "target", ["kpis", "policy_level"])


def merged(t):
    level = stage_last(client_level(t), "client_level", ["owners"])
    return stage_last(X.customer_agent_merge(t, level, stage_last(activation(t), "activation", ["kpis"])), "merged", ["client_level", "activation"])


def band_sql(col: str, edges, labels, lowest: bool = True) -> str:
    parts = []
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        test = f"{col} {'>=' if i == 0 and lowest else '>'} {low}"
        parts.append(f"when {test}" + ("" if high == X.INF else f" and {col} <= {high}") + f" then '{label}'")
    return "case " + " ".join(parts) + " end"


derived(
    "activation_measures",
    f"""select agt_code, tier, loc_cd, tenure_mth, no_sbw_completed, case when wa_cd_1 is not null then coalesce(1.0e0 - lap_14m_pol / nullif(all_pol_cnt, 0), 1.0e0) end as per_14m,
        last_12m_prd, last_12m_ape / {APE_UNIT}e0 as last_12m_ape, last_12m_month / 12.0e0 as activeness, total_po as cus_existing,
        last_mth_pol, last_3m_pol, last_6m_pol, last_9m_pol, last_12m_pol, city, coalesce(manager_name_0, manager_name_1, manager_name_2) as first_sm_name
        from agent_base left join agent_kpis on agt_code = wa_cd_1 left join location using (loc_cd)""",
)
derived(
    "agent_activation",
    "select *, "
    + ", ".join(f"{band_sql(n, e, labels)} as {n}_cat" for n, (e, labels) in X.AGENT_BANDS.items())
    + """, case when last_9m_pol > 0 then 'Active' else 'Inactive' end as manager_0_active, case when last_9m_pol = 0 then 1 else 0 end as f_agt_inactive from activation_measures""",
)


@query("agent_activation", "select * from agent_activation")
def _(t):
    return activation(t)


_CONDS = [
    ("tenure", "tenure_mth_cat = '>1 year'"),
    ("premium", "last_12m_ape_cat in ('5-7k','7-10k','10k+')"),
    ("customers", "cus_existing_cat = '>2 customers'"),
    ("persistency", "per_14m_cat = '70%+'"),
]
derived("scope_people", "select * from client_level where f_owner_is_agent = 0")
derived(
    "serving",
    """select po_num, sa_code from (select po_num, pol_num from policy where po_num in (select po_num from scope_people)
       qualify row_number() over (partition by po_num order by pol_eff_dt desc, pol_num) = 1) p left join policy_agent using (pol_num)""",
)
derived(
    "agent_target",
    f"""select a.*, case when {' and '.join(f'({x})' for _, x in _CONDS)} then 1 else 0 end as f_target_agent,
        case when last_mth_pol > 0 then '1mA' when last_3m_pol > 0 then '3mA' when last_6m_pol > 0 then '6mA' when last_9m_pol > 0 then '9mA' when last_12m_pol > 0 then '12mA'
        else '12m-Inactive' end as last_pol_cat, po_num_count
        from agent_activation a join (select sa_code, count(distinct po_num) as po_num_count from serving group by sa_code) s on s.sa_code = a.agt_code""",
)


@query("agent_target", "select * from agent_target")
def _(t):
    return target(t)


derived(
    "customer_agent_merge",
    """select p.po_num, p.no_dpnd, p.cur_age, p.adj_mthly_incm, p.client_tenure, p.inforce_pol, p.city_cd, p.vip, p.ins_typ_count, p.coverage_ape as total_ape, p.rider_cnt,
       p.dpnd_child_ind, p.dpnd_spouse_ind, s.sa_code, a.* exclude (agt_code, tier), a.tier as agent_tier
       from scope_people p left join serving s on s.po_num = p.po_num left join agent_target a on a.agt_code = s.sa_code""",
)


@query("customer_agent_merge", "select * from customer_agent_merge")
def _(t):
    return merged(t)


def _falls(counted: str, key: str, table: str) -> str:
    parts = []
    for i, (name, _) in enumerate(_CONDS):
        before = " and ".join(f"({x})" for _, x in _CONDS[:i]) or "true"
        now = " and ".join(f"({x})" for _, x in _CONDS[: i + 1])
        a, b = (f"count(distinct case when {x} then {key} end)" for x in (before, now))
        parts.append(
            f"select '{counted}' as counted, f_agt_inactive, {i + 1} as step, '{name}' as condition, {a} - {b} as removed, {b} as remaining from {table} where f_agt_inactive is not null group by f_agt_inactive"
        )
    return " union all ".join(parts)


@query("target_waterfall", _falls("agents", "agt_code", "agent_target") + " union all " + _falls("customers", "po_num", "customer_agent_merge"))
def _(t):
    both = merged(t)
    agents = both.filter("agent_tier is not null").select(
        both.sa_code.alias("agt_code"), "f_agt_inactive", "tenure_mth_cat", "last_12m_ape_cat", "cus_existing_cat", "per_14m_cat"
    )
    return X.target_waterfall(agents.distinct(), both)


@query("activation_pivot", f"select {', '.join(X.PIVOT_DIMS)}, count(distinct agt_code) as agents from agent_target group by all")
def _(t):
    return X.activation_pivot(target(t))


_MEASURES = spec_sql(X.CUSTOMER_MEASURES)


@query(
    "activation_profile",
    f"""select 'all' as scope, f_agt_inactive as flag, {_MEASURES} from customer_agent_merge group by f_agt_inactive
        union all select 'target', f_target_agent, {_MEASURES} from customer_agent_merge where f_target_agent = 1 group by f_target_agent""",
)
def _(t):
    return X.activation_profile(merged(t))


@query(
    "customer_composition",
    " union all ".join(
        f"select f_agt_inactive, '{n}' as feature, {band_sql(n, e, X.interval_labels(e), False)} as bin, count(*) as n from customer_agent_merge where f_target_agent = 1 group by all"
        for n, e in X.COMPOSITION_EDGES.items()
    ),
)
def _(t):
    return X.customer_composition(merged(t))


@query(
    "customer_top_cities",
    """with pool as (select city_cd from customer_agent_merge where f_target_agent = 1 and f_agt_inactive = 0)
       select case when city_cd in (select city_cd from pool group by city_cd order by count(*) desc, city_cd limit 15) then cast(city_cd as varchar) else 'Other' end as city_cd_grouped, count(*) as n from pool group by 1""",
)
def _(t):
    return X.customer_top_cities(merged(t), 0)


@query(
    "branch_mix",
    f"""select case when n < {MIN_BRANCH} then 'Others' else city end as city_grouped, cast(sum(n) as bigint) as n from
        (select city, count(*) as n from agent_target where f_target_agent = 1 group by city) q group by 1""",
)
def _(t):
    return X.branch_mix(target(t), MIN_BRANCH)


# ---------------------------------------------------------------- features and groups

_ZERO = ", ".join(
    f"coalesce({n}, 0) as {n}" for n in X.ZERO_FILLED if n not in ("agt_total_ape",)
)
derived(
    "agent_premium",
    f"select wa_code, {money(f'''case when pol_eff_dt <= date '{SNAP}' then tot_ape end''')} as ape from policy join policy_agent using (pol_num) where pol_stat_cd not in ('A','N','R') group by wa_code",
)
derived(
    "feature_rows",
    f"""select po_num, sa_code, total_ape, cur_age, ins_typ_count, vip, f_agt_inactive, coalesce(agent_tier, 'N/A') as agent_tier, coalesce(next_tier, 'N/A') as next_tier, {_ZERO},
        coalesce(ape / x.r, 0) as agt_total_ape from customer_agent_merge m join ex_rate x on true
        left join (select po_num, health_base, inv_base, health_rider, riders from score where deployment_approval_status = 'APPROVED') s using (po_num)
        left join (select po_num, clm_6m_cnt, clm_12m_cnt, clm_6m_amt, clm_12m_amt from owner_claims) c using (po_num)
        left join (select agt_code as sa_code, next_tier, gap_to_next_tier from tier_progress) g using (sa_code)
        left join (select wa_code as sa_code, ape from agent_premium) a using (sa_code) where total_ape > 0""",
)
derived(
    "customer_features",
    "select *, "
    + ", ".join(f"coalesce({band_sql(n, e, labels)}, 'N/A') as {n}_cat" for n, (e, labels) in X.CUSTOMER_BANDS.items())
    + " from (select *, clm_6m_amt / nullif(round(total_ape, 4), 0) as clm_6m_ratio, clm_12m_amt / nullif(round(total_ape, 4), 0) as clm_12m_ratio from feature_rows) q",
)


def features(t):
    level = stage_last(client_level(t), "client_level", ["owners"])
    measures = kpis(t)
    both = stage_last(X.customer_agent_merge(t, level, X.agent_activation(t, measures, SNAP, APE_UNIT)), "merged", ["client_level"])
    return X.customer_features(t, both, S.tier_progress(t, measures, SNAP), SNAP, rate(t))


@query("customer_features", "select * from customer_features")
def _(t):
    return features(t)


derived(
    "customer_labels",
    """select *, case vip when 'elite' then '1. Elite Platinum' when 'plat' then '2. Platinum' when 'gold' then '3. Gold' when 'silver' then '4. Silver' else '5. Unknown' end as cus_vip_cat,
       case when dpnd_child_ind = 1 then '1. Married w/ kids' when dpnd_spouse_ind = 1 then '2. Married' else '3. Unknown' end as mar_stat_cat from customer_features""",
)


@query(
    "customer_groups",
    """select po_num, mar_stat_cat, cus_vip_cat, case when mar_stat_cat in ('2. Married','3. Unknown') and no_dpnd_cat in ('2','3+') then '1. Family Guardians'
       when mar_stat_cat = '1. Married w/ kids' and no_dpnd_cat in ('1','2','3+') then '2. Mature Couples' when mar_stat_cat in ('2. Married','3. Unknown') and no_dpnd_cat = '1' then '3. Younger Couples'
       when no_dpnd_cat = '0' then '4. Personal Protection Seekers' else '5. Unknown' end as "group" from customer_labels""",
)
def _(t):
    return X.customer_groups(features(t)).select("po_num", "mar_stat_cat", "cus_vip_cat", "group")


# ---------------------------------------------------------------- customers per agent

_B = MIX_BOUNDS
derived(
    "owner_vip",
    f"""select po_num, case when ape >= 12961.76 then 'elite' when ape >= 6480.88 then 'plat' when ape >= 2808.38 then 'gold' when ape >= 864.12 and n >= 1 then 'silver' else 'none' end as vip
        from (select po_num, {money('coverage_ape', 4)} as ape, count(distinct case when inforce_year >= {LONG_YEARS} then pol_num end) as n from coverage_value group by po_num) q""",
)
derived(
    "agent_customers",
    f"""select *, case when mthly_incm < {_B[0]} then 'F' when mthly_incm <= {_B[1]} then 'E' when mthly_incm <= {_B[2]} then 'D' when mthly_incm <= {_B[3]} then 'C' when mthly_incm <= {_B[4]} then 'B' else 'A' end as vip_income_class from (
        select l.agt_cd, l.po_num, coalesce(v.vip, 'none') as vip_type, case when mthly_incm is null or cast(trunc(mthly_incm) as int) = 0 then 1 else 0 end as missing_income_ind,
        case when mthly_incm is null or cast(trunc(mthly_incm) as int) = 0 then cast(trunc(coalesce(held, 0)) as bigint) * 2 else cast(trunc(mthly_incm) as bigint) end as mthly_incm
        from (select distinct wa_code as agt_cd, po_num from policy join policy_agent using (pol_num) where pol_stat_cd not in ('8','A','R','X')) l join client k on k.cli_num = l.po_num
        left join (select po_num, {money('tot_ape')} as held from policy where pol_stat_cd in ('1','3','5') group by po_num) h on h.po_num = l.po_num left join owner_vip v on v.po_num = l.po_num) q""",
)


def agent_customers(t):
    vip = K.vip_segment(K.policy_level(K.coverage_value(t, SNAP, K.rate_of(t, SNAP, UNIT)), PRODUCTS), LONG_YEARS)
    return X.agent_customers(t, vip, MIX_BOUNDS)


@query("agent_customers", "select * from agent_customers")
def _(t):
    return agent_customers(t)


_VIPS = {"elite": "elite", "plat": "plat", "gold": "gold", "silver": "silver", "none": "nonvip"}
_COUNTED = [(f"{v}_count", f"vip_type = '{n}'") for n, v in _VIPS.items()] + [(f"class_{x}_count", f"vip_income_class = '{x}'") for x in "ABCDEF"]


@query(
    "agent_customer_mix",
    f"select {', '.join(X.MIX_DIMS)}, count(agt_cd) as agent_count, "
    + ", ".join(f"cast(sum({n}) as bigint) as {n}" for n, _ in _COUNTED)
    + " from (select agt_cd, "
    + ", ".join(f"sum(case when {cond} then 1 else 0 end) as {n}" for n, cond in _COUNTED)
    + " from agent_customers group by agt_cd) p join agent_levels using (agt_cd) group by all",
)
def _(t):
    return X.agent_customer_mix(agent_customers(t), S.agent_levels(t, SNAP), _VIPS)


# ---------------------------------------------------------------- agent segments


@query(
    "agent_performance_segments",
    """with pool as (select agt_code, po_num_count, all_pol_cnt from agent_target join agent_kpis on agt_code = wa_cd_1),
       cut as (select quantile_cont(po_num_count, 0.75) as p1, quantile_cont(po_num_count, 0.25) as p2, quantile_cont(all_pol_cnt, 0.75) as a1, quantile_cont(all_pol_cnt, 0.25) as a2 from pool)
       select pool.*, case when po_num_count >= round(p1, 4) or all_pol_cnt >= round(a1, 4) then 'Top Performers' when po_num_count >= round(p2, 4) or all_pol_cnt >= round(a2, 4) then 'High Performers'
       else 'The Slackers' end as segment from pool, cut""",
)
def _(t):
    measures = kpis(t)
    agents = X.agent_target(t, X.agent_activation(t, measures, SNAP, APE_UNIT), X.in_scope_customers(client_level(t, cut=False)))
    rows = stage(agents.select("agt_code", "po_num_count"), "agents")
    return X.agent_performance_segments(rows, measures)


@query(
    "assign_segment",
    """with cut as (select round(quantile_cont(tot_ape, 0.75), 4) as high, round(quantile_cont(tot_ape, 0.25), 4) as low from policy)
       select pol_num, case when tot_ape >= high then 'Top' when tot_ape >= low then 'High' else 'Rest' end as segment from policy, cut""",
)
def _(t):
    rows = t["policy"].select("pol_num", "tot_ape")
    return agg.assign_segment(rows, ["tot_ape"], [0.75, 0.25], ["Top", "High", "Rest"]).select("pol_num", "segment")
