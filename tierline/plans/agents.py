"""Agent mart: income, base, coverage fact, KPIs, claims, work lists, tier progress, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions import bands, dates, money, text
from tierline.operators import aggregates as agg
from tierline.operators import joins, ordered, ranking
from tierline.plans.common import ACTIVE, DROPPED_FROM_INCOME, NOT_SOLD, Frames, day, exchange_rate, sold
from tierline.sources.sink import stage

c = F.col

# ---------------------------------------------------------------- income


def income_windows(issued: str, snapshot: str) -> dict[str, str]:
    gap = f"months_between(date '{snapshot}', {issued})"
    return {
        "last_mth": f"date_format({issued}, 'yyyy-MM') = '{snapshot[:7]}'",
        **{f"last_{m}m": f"{gap} < {m}" for m in (3, 6, 9, 12)},
        "ly": f"year({issued}) = {int(snapshot[:4]) - 1}",
        "total": "true",
    }


def agent_income(t: Frames, snapshot: str) -> DataFrame:
    """Premium and commission per agent by issue-date window; commission also converted.

    Commission and first-year premium come from the same coverage rows, so both are summed per
    agent and policy in one grouping; whole units per policy as in the source ledgers.
    """
    snap = day(snapshot)
    cov = t["coverage"]
    earned = (c("cvg_eff_dt") <= snap) & (c("cvg_prem") * c("nbv_margin") > 0)
    per_policy = (
        cov.groupBy(c("wa_code").alias("agt_cd"), "pol_num")
        .agg(
            money.total(F.when(earned, c("cvg_prem") * c("nbv_margin")), 4).alias("comm"),
            money.total_or_zero(F.when(c("cvg_typ") == "B", c("cvg_prem"))).alias("fyp"),
            money.total_or_zero(F.when(c("cvg_typ") == "R", c("cvg_prem"))).alias("top_up"),
        )
        .filter(c("comm").isNotNull())
        .select(
            "agt_cd",
            "pol_num",
            (c("fyp") + c("top_up")).cast("long").alias("fyp"),
            c("comm").cast("long").alias("comm"),
        )
    )
    kept = t["policy"].filter(~c("pol_stat_cd").isin(DROPPED_FROM_INCOME)).select("pol_num", "pol_eff_dt")
    windows = income_windows("pol_eff_dt", snapshot)
    sums = (
        per_policy.join(kept, "pol_num")
        .groupBy("agt_cd")
        .agg(
            *[
                F.expr(f"sum(case when {cond} then {col} else 0L end)").alias(f"{name}_{col}")
                for col in ("fyp", "comm")
                for name, cond in windows.items()
            ]
        )
    )
    rate = exchange_rate(t, snapshot)
    return sums.withColumns({f"{w}_comm_usd": money.money_convert(c(f"{w}_comm"), rate, 1000) for w in windows})


# Upper bounds of monthly income classes, in thousands of local currency.
INCOME_CLASSES = [
    (5000, "F. Under 5M"),
    (7500, "E. 5M - 7.5M"),
    (10000, "D. 7.5M - 10M"),
    (15000, "C. 10M - 15M"),
    (20000, "B. 15M - 20M"),
]


def income_class(col: Column) -> Column:
    rules = [(col.isNull() | (col == 0), "G. No Income"), (col < 5000, "F. Under 5M")]
    rules += [(col <= top, label) for top, label in INCOME_CLASSES[1:]]
    return bands.first_match(rules, "A. Above 20M")


def agent_income_class(t: Frames, snapshot: str) -> DataFrame:
    """All agents with income per month of tenure, income of the last 12 months, and classes."""
    agents = t["agent"].select(
        c("agt_code").alias("agt_cd"),
        "tier",
        "loc_cd",
        "birth_dt",
        dates.whole_months(day(snapshot), c("agt_join_dt")).alias("tenure_mth"),
    )
    income = agent_income(t, snapshot)
    joined = agents.join(income, "agt_cd", "left").na.fill(0, [n for n in income.columns if n != "agt_cd"])
    tenure = c("tenure_mth").cast("double")

    def monthly(col: str, months: Column) -> Column:
        per = F.try_divide(c(col).cast("double"), months)
        return F.coalesce(F.when(c(col) > 0, per), F.lit(0.0))

    def cents(col: str, months: Column) -> Column:
        per = F.try_divide(money.exact(c(col)), months.cast("decimal(10,0)"))
        return F.coalesce(F.when(c(col) > 0, per), F.lit(0)).cast("decimal(18,2)").cast("double")

    out = joined.withColumns(
        {
            "mthly_incm": F.round(monthly("total_comm", tenure), 0).cast("int"),
            "last_12m_mthly_incm": F.round(monthly("last_12m_comm", F.lit(12.0)), 0).cast("int"),
            "mthly_incm_usd": cents("total_comm_usd", c("tenure_mth")),
            "last_12m_mthly_incm_usd": cents("last_12m_comm_usd", F.lit(12)),
        }
    )
    return out.withColumns(
        {
            "income_class": income_class(c("mthly_incm")),
            "last_12m_income_class": income_class(c("last_12m_mthly_incm")),
        }
    )


# Age bands of agents.
AGENT_AGE_BANDS = [(18, 29, "1. 18 - 29"), (30, 44, "2. 30 - 44"), (45, 54, "3. 45 - 54")]


def recent_sellers(t: Frames, snapshot: str) -> DataFrame:
    """Agents with a policy in the last nine months."""
    offset = dates.month_offset(c("pol_eff_dt"), day(snapshot))
    recent = t["policy"].filter(sold() & offset.between(-9, -1)).select("pol_num")
    return joins.join_merged(t["policy_agent"], recent, ["pol_num"], "left_semi").select(c("wa_code").alias("agt_cd"))


def agent_levels(t: Frames, snapshot: str) -> DataFrame:
    """Agents with tier rank, activity, income deciles, age band, hierarchy labels, location."""
    base = stage(agent_income_class(t, snapshot))
    orders = {
        "income_decile": [("mthly_incm_usd", "desc"), ("agt_cd", "asc")],
        "recent_income_decile": [("last_12m_mthly_incm_usd", "desc"), ("agt_cd", "asc")],
    }
    ranked = ordered.ntile_multi(base, 10, orders)
    age = F.floor(F.months_between(day(snapshot), c("birth_dt")) / 12).cast("int")
    age_rules = [(c("agent_age").between(a, b), label) for a, b, label in AGENT_AGE_BANDS]
    age_rules.append((c("agent_age") > 54, "4. 55+"))
    flagged = joins.flag_exists(ranked, recent_sellers(t, snapshot), "agt_cd", "_recent")
    return (
        flagged.join(t["location"], "loc_cd", "left")
        .withColumns(
            {
                "tier_rank": bands.map_codes(c("tier"), bands.TIER_RANK),
                "sa_status": 1 - c("_recent"),
                "agent_age": age,
                "unit_label": text.labelled(c("loc_cd"), c("manager_name_0")),
                "branch_label": text.labelled(c("loc_cd"), c("manager_name_1")),
            }
        )
        .withColumn("age_band", bands.first_match(age_rules, "0. Under 18"))
        .drop("_recent", "manager_name_0", "manager_name_1", "manager_name_2")
    )


def income_decile_summary(t: Frames, snapshot: str) -> DataFrame:
    """Agents and mean income per decile of the last 12 months' income."""
    frame = stage(agent_income_class(t, snapshot).select("agt_cd", "last_12m_mthly_incm_usd"))
    order = [("last_12m_mthly_incm_usd", "desc"), ("agt_cd", "asc")]
    ranked = ordered.ntile_global(frame, 10, order, "income_decile")
    return ranked.groupBy("income_decile").agg(
        F.count("*").alias("agent_count"), money.mean(c("last_12m_mthly_incm_usd")).alias("mean_income_usd")
    )


# ---------------------------------------------------------------- base and fact


def agent_base(t: Frames, snapshot: str) -> DataFrame:
    """Agents under contract with tier, tenure and number of completed trainings."""
    slots = [n for n in t["training"].columns if n.startswith("sbw")]
    trained = agg.count_present(t["training"], "agt_code", slots, "no_sbw_completed")
    return (
        t["agent"]
        .filter(c("comp_prvd_num").isin("01", "98") & c("trmn_dt").isNull())
        .drop("no_sbw_completed")
        .join(trained, "agt_code", "left")
        .select(
            "agt_code",
            "agt_nm",
            "loc_cd",
            "agt_join_dt",
            "comp_prvd_num",
            "id_num",
            F.coalesce("tier", F.lit("Unranked")).alias("tier"),
            dates.whole_months(day(snapshot), c("agt_join_dt")).alias("tenure_mth"),
            F.coalesce("no_sbw_completed", F.lit(0)).alias("no_sbw_completed"),
        )
    )


def agent_own_purchases(t: Frames, snapshot: str) -> DataFrame:
    """Policies whose owner carries the id number of an agent of the base."""
    ids = agent_base(t, snapshot).select("id_num").distinct()
    buyers = t["client"].select("cli_num", "id_num").join(ids, "id_num").select(
        c("cli_num").alias("po_num"), c("id_num").alias("cli_id_num_agt_buy")
    )
    return t["policy"].select("pol_num", "po_num", "tot_ape").join(buyers.distinct(), "po_num", "left")


def first_policies(t: Frames) -> DataFrame:
    """The earliest sold policy of each owner."""
    order = [("pol_eff_dt", "asc"), ("pol_num", "asc")]
    return ranking.first_per_key(t["policy"].filter(sold()).select("po_num", "pol_num", "pol_eff_dt"), ["po_num"], order)


# What `coverage_fact` writes.
FACT_STAGES = ("policies", "coverages")


def coverage_fact(t: Frames, snapshot: str) -> DataFrame:
    """One row per coverage of the base agents up to the snapshot, with adjusted premium and NBV.

    The policy side is put together first (owner, writing agent, first-policy flag: all one row per
    policy), and the coverages meet their plans on their own, so both meet in one join. Both are written before, which
    ends the shuffles they took.
    """
    snap = day(snapshot)
    agents = agent_base(t, snapshot).select(c("agt_code").alias("wa_cd_1"), "agt_join_dt", "tier")
    people = t["client"].select("cli_num", "cur_age", "sex_code")
    firsts = first_policies(t).select("pol_num", F.lit(1).alias("if_first_pol"))
    owners = people.select(
        c("cli_num").alias("po_num"), c("cur_age").alias("po_age"), c("sex_code").alias("po_gender")
    )
    policies = t["policy"].filter(c("pol_eff_dt") <= snap).select("pol_num", "po_num", "pol_eff_dt", "pol_trmn_dt", "pol_stat_cd", "pmt_mode")
    written = t["policy_agent"].select("pol_num", c("wa_code").alias("wa_cd_1")).join(agents, "wa_cd_1")
    policies = joins.join_merged(joins.join_merged(policies, owners, ["po_num"]), firsts, ["pol_num"])
    policies = stage(joins.join_merged(policies, written, ["pol_num"], "inner"), "policies")
    history = t["margin_history"].withColumnRenamed("nbv_margin", "dated_margin")
    cov = t["coverage"].filter(c("cvg_eff_dt") <= snap).select(
        "pol_num", "cvg_num", "plan_code", "cvg_eff_dt", "cvg_prem", "cvg_typ", "cvg_stat_cd", "cvg_del_dt", "insrd_num", "rel_to_insrd"
    )
    priced = joins.interval_join(cov, history, ["plan_code"], "cvg_eff_dt", "effective_date", 0, 2, "left").drop("effective_date")
    plans = t["plan"].select("plan_code", "ins_typ_desc", "sngl_prem_ind", "nbv_margin_a")
    insured = people.select(
        c("cli_num").alias("cli_num"), c("cur_age").alias("in_age"), c("sex_code").alias("in_gender")
    )
    priced = stage(joins.join_merged(priced, plans, ["plan_code"]), "coverages")
    rows = joins.join_merged(priced, policies, ["pol_num"], "inner")
    rows = joins.join_merged(rows.withColumn("cli_num", F.coalesce("insrd_num", "po_num")), insured, ["cli_num"])
    same = bands.flag(c("po_num") == c("cli_num"))
    gap = F.when(same == 0, c("po_age") - c("in_age"))
    ape = F.when(c("cvg_stat_cd").isin(NOT_SOLD), F.lit(0.0)).otherwise(money.annualise(c("cvg_prem"), c("pmt_mode")))
    days = F.datediff(F.least("pol_trmn_dt", "cvg_del_dt"), c("pol_eff_dt"))
    first = F.coalesce("if_first_pol", F.lit(0))
    facts = rows.select(
        "pol_num", "cvg_num", "plan_code", "po_num", "cli_num", "wa_cd_1", "tier", "pol_stat_cd", "pmt_mode",
        "cvg_typ", "cvg_prem", "cvg_eff_dt", "pol_eff_dt", "pol_trmn_dt",
        c("ins_typ_desc").alias("type"),
        ape.alias("ape"),
        days.alias("pol_eff_days"),
        money.adjusted_ape(days, c("pmt_mode"), c("cvg_prem"), ape, c("sngl_prem_ind") == "Y").alias("adjust_ape"),
        joins.lookup_coalesce(c("dated_margin"), c("nbv_margin_a")).alias("nbv_margin"),
        bands.relation_label(c("rel_to_insrd")).alias("insrd"),
        bands.infer_relation(same, gap, c("po_gender"), c("in_gender")).alias("po_ins_rela"),
        (F.months_between("cvg_eff_dt", "pol_eff_dt") + 1).cast("int").alias("cvg_eff_mth_from_pol_eff"),
        (F.months_between("cvg_eff_dt", "agt_join_dt") + 1).cast("int").alias("cvg_eff_mth_from_agt_join"),
        (dates.elapsed(c("cvg_eff_dt"), c("agt_join_dt"), 7.0).cast("int") + 1).alias("cvg_eff_week_from_agt_join"),
        dates.year_month(c("cvg_eff_dt")).alias("year_month"),
        dates.month_offset(c("cvg_eff_dt"), snap).alias("mth_offset"),
        bands.flag(c("pol_stat_cd").isin(ACTIVE)).alias("pol_active"),
        bands.flag(c("pol_stat_cd").isin("A", "N")).alias("is_non_taken"),
        bands.flag(c("pol_stat_cd") == "R").alias("rejected"),
        bands.flag(c("pol_stat_cd") == "B").alias("lapsed"),
        first.alias("if_first_pol"),
        bands.flag(sold() & (first == 0)).alias("repeated_sales"),
    )
    return facts.withColumns(
        {
            "nbv": c("adjust_ape") * c("nbv_margin"),
            "prd_cus_mix": F.concat_ws("_", "type", "po_ins_rela"),
        }
    )


def family_mix(fact: DataFrame) -> DataFrame:
    """Coverages, owners and premium per product and inferred relation."""
    per_owner = fact.groupBy("type", "po_ins_rela", "prd_cus_mix", "po_num").agg(
        F.count("*").alias("n"), F.sum(money.exact(c("adjust_ape"), 3)).alias("ape")
    )
    return per_owner.groupBy("type", "po_ins_rela", "prd_cus_mix").agg(
        F.sum("n").alias("n_cvg"), F.count("po_num").alias("n_owners"), F.sum("ape").cast("double").alias("adjust_ape")
    )


# ---------------------------------------------------------------- KPIs

# What the KPI families read of the coverage fact; a job that writes the fact once keeps these.
KPI_COLUMNS = [
    "wa_cd_1", "pol_num", "po_num", "cli_num", "type", "po_ins_rela", "year_month", "mth_offset", "cvg_eff_dt",
    "pol_eff_dt", "pol_trmn_dt", "pol_stat_cd", "cvg_typ", "adjust_ape", "nbv", "is_non_taken", "rejected", "lapsed", "repeated_sales",
]
SHORT_WINDOWS = ["last_mth", "last_3m", "last_6m", "last_9m", "last_12m"]


def agent_kpis(fact: DataFrame, snapshot: str) -> DataFrame:
    """Thirteen measure families by eight windows per writing agent.

    All sums are one grouping by agent; all distinct counts are one grouping by agent and item
    followed by one by agent.
    """
    held = F.months_between("pol_trmn_dt", "pol_eff_dt")
    rows = fact.withColumns({"cvg_eff_yr": F.year("cvg_eff_dt"), "months_held": held})
    windows = agg.trailing_windows("mth_offset", "cvg_eff_yr", int(snapshot[:4]))
    good = f"pol_stat_cd not in ({', '.join(repr(x) for x in NOT_SOLD)})"
    sums = agg.trailing_sums(
        rows.filter(good),
        ["wa_cd_1"],
        ["mth_offset", "cvg_eff_yr"],
        windows,
        {
            "ape": ("adjust_ape", 3),
            "nbv": ("nbv", 5),
            "rid": ("case when cvg_typ = 'R' then adjust_ape end", 3),
            "rep": ("case when repeated_sales = 1 then adjust_ape end", 3),
            "rep_nbv": ("case when repeated_sales = 1 then nbv end", 5),
        },
    )
    families = {
        "po_num": {"po": good},
        "cli_num": {"cus": good},
        "pol_num": {"pol": good, "nt": "is_non_taken = 1", "rej": "rejected = 1", "lap": "lapsed = 1"},
        "type": {"prd": good},
        "po_ins_rela": {"fam": good},
        "year_month": {"month": good},
    }
    single = {
        "pol_num": {
            "all_pol_cnt": good,
            **{f"lap_{m}m_pol": f"lapsed = 1 and months_held <= {m}" for m in (14, 20, 26)},
        }
    }
    counts = agg.trailing_distinct(rows, "wa_cd_1", windows, families, single)
    joined = sums.join(counts, "wa_cd_1", "left")
    return joined.na.fill(0, [n for n in counts.columns if n != "wa_cd_1"])


SIZE_WINDOWS = ["last_yr", *SHORT_WINDOWS]


def agent_ticket_size(kpis: DataFrame) -> DataFrame:
    """Premium per policy and per owner; 1 where there is none."""
    sizes = [
        f"coalesce(try_divide(cast({w}_ape as double), cast({w}_{item} as double)), 1.0d) as {w}_{item}_size"
        for item in ("pol", "po")
        for w in SIZE_WINDOWS
    ]
    return kpis.selectExpr("wa_cd_1", *sizes)


def agent_persistency(kpis: DataFrame) -> DataFrame:
    """Share of policies not refused, not rejected, not lapsed; 1 where there are no policies."""

    def kept(lost: str, of: str) -> str:
        return f"coalesce(1.0d - try_divide(cast({lost} as double), cast({of} as double)), 1.0d)"

    rates = [
        f"{kept(f'{w}_{kind}', f'{w}_pol')} as {w}_{kind}_per" for kind in ("nt", "rej", "lap") for w in SHORT_WINDOWS
    ]
    held = [f"{kept(f'lap_{m}m_pol', 'all_pol_cnt')} as per_{m}m" for m in (14, 20, 26)]
    return kpis.selectExpr("wa_cd_1", *rates, *held)


def agent_sales_trend(fact: DataFrame) -> DataFrame:
    """Premium per agent and month of the last 12 months beside the mean over agents."""
    monthly = (
        fact.filter(sold() & c("mth_offset").between(-12, -1))
        .groupBy(c("wa_cd_1").alias("agt_cd"), c("year_month").alias("date"))
        .agg(money.total(c("adjust_ape"), 3).alias("avg_ape_agt"))
    )
    # Twelve months give at most twelve rows.
    overall = monthly.groupBy("date").agg(money.mean(c("avg_ape_agt"), 3).cast("long").alias("avg_ape_tier"))
    return monthly.join(F.broadcast(overall), "date")


def agent_product_totals(fact: DataFrame) -> DataFrame:
    """Premium per agent and product of the last 12 months beside the product's total."""
    per = (
        fact.filter(sold() & c("mth_offset").between(-12, -1))
        .groupBy(c("wa_cd_1").alias("agt_cd"), c("type").alias("prd_type"))
        .agg(money.total(c("adjust_ape"), 3).alias("sum_ape_agt"))
    )
    overall = per.groupBy("prd_type").agg(money.total(c("sum_ape_agt"), 3).cast("long").alias("sum_ape_tier"))
    return per.join(overall, "prd_type")


# ---------------------------------------------------------------- claims, lists, tiers


def base_policies(t: Frames, snapshot: str) -> DataFrame:
    """Policy and its writing agent, for agents of the base."""
    agents = agent_base(t, snapshot).select(c("agt_code").alias("agt_cd"))
    return t["policy_agent"].select("pol_num", c("wa_code").alias("agt_cd")).join(agents, "agt_cd", "left_semi")


def agent_claims(t: Frames, snapshot: str) -> DataFrame:
    """Claims of three years and open claims of one year per agent.

    Rows are merged per agent and claim before the agent is summed.
    """
    snap = day(snapshot)
    recent = t["claim"].filter(c("clm_recv_dt").between(F.add_months(snap, -36), snap))
    rows = recent.select("pol_num", "clm_id", "clm_recv_dt", "clm_stat_code", "clm_prvd_amt", "clm_aprov_amt")
    approved = c("clm_stat_code") == "A"
    open_1y = (c("clm_stat_code") == "I") & (c("clm_recv_dt") >= F.add_months(snap, -12))
    per_claim = (
        rows.join(base_policies(t, snapshot), "pol_num")
        .distinct()
        .groupBy("agt_cd", "clm_id")
        .agg(
            F.sum(money.exact(c("clm_prvd_amt"))).alias("amt"),
            F.sum(F.when(approved, money.exact(c("clm_aprov_amt"), 4))).alias("appr_amt"),
            F.max(F.when(approved, 1).otherwise(0)).alias("appr"),
            F.max(F.when(open_1y, 1).otherwise(0)).alias("wip"),
        )
    )
    return per_claim.groupBy("agt_cd").agg(
        F.count("clm_id").alias("claim_cnt_last_3_yr"),
        F.sum("amt").cast("double").alias("claim_amt_last_3_yr"),
        F.sum("appr").alias("claim_appr_cnt_last_3_yr"),
        F.coalesce(F.sum("appr_amt").cast("double"), F.lit(0.0)).alias("claim_appr_amt_last_3_yr"),
        F.sum("wip").alias("claim_wip_last_1_yr"),
        (F.sum("appr").cast("double") / F.count("clm_id")).alias("claim_appr_rate_last_3_yr"),
    )


def lapse_watchlist(t: Frames, snapshot: str, floor: float = 0.05, k: int = 3) -> DataFrame:
    """The policies of each agent most likely to lapse."""
    risky = t["lapse"].filter(c("lapse_score") >= floor).join(base_policies(t, snapshot), "pol_num")
    order = [("lapse_score", "desc"), ("pol_num", "asc")]
    return agg.collect_per_key(risky, "agt_cd", order, "pol_num", k, "lps_pol_list")


LEAD_SCORES = ["health_base", "inv_base", "health_rider", "riders"]


def lead_list(t: Frames, snapshot: str, per_agent: int = 10, mark_above: float = 0.1) -> DataFrame:
    """Best leads per agent with product marks and one policy of the lead.

    An owner with several agents or policies gets the lowest code of each.
    """
    owned = t["policy"].select("po_num", "pol_num").join(base_policies(t, snapshot), "pol_num")
    of_owner = owned.groupBy("po_num").agg(F.min("agt_cd").alias("agt_cd"), F.min("pol_num").alias("pol_num"))
    order = [("p_1", "desc"), ("po_num", "asc")]
    best = ranking.top_k_per_key(t["score"].join(of_owner, "po_num"), ["agt_cd"], order, per_agent)
    approved = best.filter(c("deployment_approval_status") == "APPROVED").withColumn(
        "which_prd", bands.argmax_columns(LEAD_SCORES)
    )

    def mark(cond: Column) -> Column:
        return F.when(cond, "*").otherwise("")

    marks = {n: mark(c(n) > mark_above) for n in LEAD_SCORES}
    marks["inv_base"] = mark(c("which_prd") == "inv_base")
    return approved.select(
        "agt_cd", "po_num", "pol_num", "which_prd", *[m.alias(n) for n, m in marks.items()], "p_1"
    )


def lead_policies(leads: DataFrame, k: int = 3) -> DataFrame:
    return agg.collect_per_key(leads, "agt_cd", [("p_1", "desc"), ("po_num", "asc")], "pol_num", k, "cpm_pol_list")


def tier_progress(t: Frames, kpis: DataFrame, snapshot: str) -> DataFrame:
    """Next tier, its benchmark and the gap to it, rank by last month's premium, tenure text."""
    sales = kpis.select(c("wa_cd_1").alias("agt_code"), "last_mth_ape", "ytd_ape")
    base = stage(
        agent_base(t, snapshot)
        .join(sales, "agt_code", "left")
        .select("agt_code", "tier", "tenure_mth", "ytd_ape", F.coalesce("last_mth_ape", F.lit(0.0)).alias("last_mth_ape"))
    )
    ranked = ordered.average_rank(base, "last_mth_ape", "rank_of_last_mth_ape")
    up = ranked.withColumn("next_tier", bands.next_tier(c("tier"))).withColumn(
        "next_tier_benchmark", bands.map_codes(c("next_tier"), bands.TIER_BENCHMARK)
    )
    return up.select(
        "agt_code", "tier", "last_mth_ape", "rank_of_last_mth_ape", "next_tier", "next_tier_benchmark",
        money.gap_to_target(c("next_tier_benchmark"), c("ytd_ape")).alias("gap_to_next_tier"),
        text.years_months(c("tenure_mth")).alias("tenure_ym"),
    )


# ---------------------------------------------------------------- reports


def agent_report_by_class(levels: DataFrame) -> DataFrame:
    return levels.groupBy("last_12m_income_class").agg(
        F.count("agt_cd").alias("agent_count"),
        money.mean(c("last_12m_mthly_incm")).cast("int").alias("mthly_income_last_12m"),
    )


def agent_report_by_place(levels: DataFrame) -> DataFrame:
    active = levels.filter(c("sa_status") == 0)
    return active.groupBy("region", "city", "last_12m_income_class", "age_band").agg(
        F.count("agt_cd").alias("agent_count"),
        money.mean(c("last_12m_mthly_incm")).cast("int").alias("avg_mthly_income_last_12m"),
    )


def agent_report_by_tier(levels: DataFrame) -> DataFrame:
    tier = F.when(c("tier").isin("TOT", "COT"), "MDRT").otherwise(c("tier"))
    return (
        levels.filter(c("sa_status") == 0)
        .groupBy(tier.alias("tier"))
        .agg(
            F.count("agt_cd").alias("agent_count"),
            money.mean(c("last_12m_mthly_incm")).alias("mthly_income_last_12m"),
            money.mean(c("mthly_incm")).alias("mthly_income"),
        )
        .orderBy(F.desc("mthly_income"), "tier")
    )


def agent_total_premium(t: Frames, snapshot: str) -> DataFrame:
    """Premium of sold policies per writing agent up to the snapshot, converted."""
    sums = (
        t["policy"]
        .filter(sold())
        .join(t["policy_agent"].select("pol_num", "wa_code"), "pol_num")
        .groupBy("wa_code")
        .agg(money.total(F.when(c("pol_eff_dt") <= day(snapshot), c("tot_ape"))).alias("ape"))
    )
    return sums.select("wa_code", (c("ape") / exchange_rate(t, snapshot)).alias("agt_total_ape"))


def agent_stored_balance(t: Frames, snapshot: str) -> DataFrame:
    """Balance kept for each agent, for agents of the base only."""
    balances = t["agent"].select(c("agt_code").alias("agt_cd"), c("acum_bal").alias("m19_per"))
    return joins.join_semi(balances, agent_base(t, snapshot), {"agt_cd": "agt_code"})
