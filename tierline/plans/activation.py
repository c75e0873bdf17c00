"""Agent activation: banded agents, targets and their waterfall, customers beside their agents,
customer features and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions import bands, money
from tierline.operators import aggregates as agg
from tierline.operators import filters, joins, ranking
from tierline.plans import agents as agent_plans
from tierline.plans import customers as customer_plans
from tierline.plans.common import Frames

c = F.col
INF = bands.INF

# Edges and labels of the agent bands.
AGENT_BANDS: dict[str, tuple[list[float], list[str]]] = {
    "tenure_mth": ([0, 12, INF], ["<=1 year", ">1 year"]),
    "per_14m": ([0, 0.7, 1], ["<=70%", "70%+"]),
    "last_12m_prd": ([-1, 2, INF], ["<=2 product types", ">2 product types"]),
    "last_12m_ape": ([0, 5000, 7000, 10000, INF], ["<=5k", "5-7k", "7-10k", "10k+"]),
    "activeness": ([0, 0.3, 0.6, 1], ["Low", "Medium", "High"]),
    "cus_existing": ([0, 2, INF], ["<=2 customers", ">2 customers"]),
    "no_sbw_completed": ([-1, 0, INF], ["No trainings completed", "at least 1 training completed"]),
}
MANAGER_LEVELS = ["manager_name_0", "manager_name_1", "manager_name_2"]
POLICY_WINDOWS = {"last_mth": "1mA", "last_3m": "3mA", "last_6m": "6mA", "last_9m": "9mA", "last_12m": "12mA"}


def agent_activation(t: Frames, kpis: DataFrame, snapshot: str, ape_unit: float = 1.0) -> DataFrame:
    """Agents of the base with banded features, manager, and activity in the last nine months."""
    base = agent_plans.agent_base(t, snapshot).select("agt_code", "tier", "loc_cd", "tenure_mth", "no_sbw_completed")
    held = agent_plans.agent_persistency(kpis).select("wa_cd_1", "per_14m")
    measures = kpis.join(held, "wa_cd_1").select(
        c("wa_cd_1").alias("agt_code"),
        "per_14m",
        "last_12m_prd",
        (c("last_12m_ape") / F.lit(ape_unit)).alias("last_12m_ape"),
        (c("last_12m_month") / F.lit(12.0)).alias("activeness"),
        c("total_po").alias("cus_existing"),
        *[f"{w}_pol" for w in POLICY_WINDOWS],
    )
    managers = t["location"].select("loc_cd", "city", ranking.first_non_null(MANAGER_LEVELS).alias("first_sm_name"))
    rows = joins.star_join(base, [(measures, ["agt_code"]), (managers, ["loc_cd"])])
    active = c("last_9m_pol") > 0
    return rows.withColumns(
        {
            **{f"{n}_cat": bands.band(c(n), edges, labels) for n, (edges, labels) in AGENT_BANDS.items()},
            "manager_0_active": F.when(active, "Active").otherwise("Inactive"),
            "f_agt_inactive": bands.flag(c("last_9m_pol") == 0),
        }
    )


def target_steps() -> list[tuple[str, Column]]:
    """The conditions of a target agent in the order of the report."""
    return [
        ("tenure", c("tenure_mth_cat") == ">1 year"),
        ("premium", c("last_12m_ape_cat").isin("5-7k", "7-10k", "10k+")),
        ("customers", c("cus_existing_cat") == ">2 customers"),
        ("persistency", c("per_14m_cat") == "70%+"),
    ]


def with_target(activation: DataFrame) -> DataFrame:
    """Target flag, and the shortest recent window in which the agent sold a policy."""
    met = [cond for _, cond in target_steps()]
    recent = [(c(f"{w}_pol") > 0, label) for w, label in POLICY_WINDOWS.items()]
    return activation.withColumns(
        {
            "f_target_agent": bands.flag(met[0] & met[1] & met[2] & met[3]),
            "last_pol_cat": bands.first_match(recent, "12m-Inactive"),
        }
    )


def serving_agents(t: Frames, owners: DataFrame) -> DataFrame:
    """The servicing agent of each owner's newest policy."""
    wanted = owners.select("po_num").distinct()
    mine = joins.join_merged(t["policy"].select("po_num", "pol_num", "pol_eff_dt"), wanted, ["po_num"], "left_semi")
    newest = ranking.latest_per_key(mine, ["po_num"], [("pol_eff_dt", "desc"), ("pol_num", "asc")])
    return joins.join_merged(newest, t["policy_agent"].select("pol_num", "sa_code"), ["pol_num"]).select("po_num", "sa_code")


def agent_target(t: Frames, activation: DataFrame, owners: DataFrame) -> DataFrame:
    """Agents serving in-scope customers, with the number of those customers."""
    links = serving_agents(t, owners).filter(c("sa_code").isNotNull()).select(c("sa_code").alias("agt_code"), "po_num")
    return agg.count_related(with_target(activation), links, "agt_code", "po_num", "po_num_count")


def in_scope_customers(level: DataFrame) -> DataFrame:
    """Customers who are not agents themselves."""
    return level.filter(c("f_owner_is_agent") == 0)


def customer_agent_merge(t: Frames, level: DataFrame, activation: DataFrame) -> DataFrame:
    """Each in-scope customer beside the agent serving them (NULL agent columns if out of scope)."""
    people = in_scope_customers(level).select(
        "po_num", "no_dpnd", "cur_age", "adj_mthly_incm", "client_tenure", "inforce_pol", "city_cd", "vip",
        "ins_typ_count", c("coverage_ape").alias("total_ape"), "rider_cnt", "dpnd_child_ind", "dpnd_spouse_ind",
    )
    target = agent_target(t, activation, people).withColumnsRenamed({"agt_code": "sa_code", "tier": "agent_tier"})
    return joins.join_merged(people, serving_agents(t, people), ["po_num"]).join(target, "sa_code", "left")


def target_waterfall(agents: DataFrame, merged: DataFrame) -> DataFrame:
    """Agents and customers left after each target condition, inactive and active agents apart."""
    by = ["f_agt_inactive"]
    of_agents = filters.waterfall(agents, target_steps(), "agt_code", by)
    known = merged.filter(c("f_agt_inactive").isNotNull())
    of_customers = filters.waterfall(known, target_steps(), "po_num", by)
    return of_agents.select(F.lit("agents").alias("counted"), "*").unionByName(
        of_customers.select(F.lit("customers").alias("counted"), "*")
    )


PIVOT_DIMS = ["f_agt_inactive", "tenure_mth_cat", "last_pol_cat", "last_12m_ape_cat", "cus_existing_cat", "per_14m_cat"]


def activation_pivot(agents: DataFrame) -> DataFrame:
    return agg.crosstab_counts(agents, PIVOT_DIMS, "agents")


CUSTOMER_MEASURES: list[agg.Measure] = [
    ("customers", "count", "po_num", None, 0),
    ("no_dpnd", "mean", "no_dpnd", None, 4),
    ("cur_age", "mean", "cur_age", None, 4),
    ("adj_mthly_incm", "mean", "adj_mthly_incm", None, 4),
    ("client_tenure", "mean", "client_tenure", None, 4),
    ("inforce_pol", "mean", "inforce_pol", None, 4),
    ("total_ape", "mean", "total_ape", None, 4),
    ("rider_cnt", "mean", "rider_cnt", None, 4),
]


def activation_profile(merged: DataFrame) -> DataFrame:
    """Customers of all agents by activity, and of the target agents."""
    every = agg.profile(merged, ["f_agt_inactive"], CUSTOMER_MEASURES)
    target = agg.profile(merged.filter(c("f_target_agent") == 1), ["f_target_agent"], CUSTOMER_MEASURES)
    return every.select(F.lit("all").alias("scope"), c("f_agt_inactive").alias("flag"), *[m[0] for m in CUSTOMER_MEASURES]).unionByName(
        target.select(F.lit("target").alias("scope"), c("f_target_agent").alias("flag"), *[m[0] for m in CUSTOMER_MEASURES])
    )


# Bin edges of the customer composition tables.
COMPOSITION_EDGES = {
    "no_dpnd": [0, 1, 2, 3, INF],
    "cur_age": [0, 25, 35, 55, INF],
    "adj_mthly_incm": [0, 1000, 2000, 3000, INF],
    "client_tenure": [0, 1, 2, 3, 4, 5, INF],
    "inforce_pol": [0, 1, 2, 3, INF],
    "total_ape": [0, 1000, 2000, 3000, INF],
    "rider_cnt": [0, 1, 2, 3, INF],
}


def interval_labels(edges: Sequence[float]) -> list[str]:
    return [f"({low}, {'inf' if high == INF else high}]" for low, high in zip(edges, edges[1:])]


def customer_composition(merged: DataFrame, by: str = "f_agt_inactive") -> DataFrame:
    """Counts per bin of seven features for customers of the target agents, in one pass."""
    cells = [
        F.struct(F.lit(n).alias("feature"), bands.band(c(n), e, interval_labels(e), include_lowest=False).alias("bin"))
        for n, e in COMPOSITION_EDGES.items()
    ]
    target = merged.filter(c("f_target_agent") == 1)
    return target.select(by, F.inline(F.array(*cells))).groupBy(by, "feature", "bin").agg(F.count("*").alias("n"))


def customer_top_cities(merged: DataFrame, inactive: int, n: int = 15) -> DataFrame:
    """Counts of the most frequent cities of the target agents' customers; the rest together."""
    target = merged.filter((c("f_target_agent") == 1) & (c("f_agt_inactive") == inactive)).select("city_cd")
    return ranking.top_categories(target, "city_cd", n).groupBy("city_cd_grouped").agg(F.count("*").alias("n"))


def branch_mix(agents: DataFrame, min_count: int = 20) -> DataFrame:
    """Target agents per branch, small branches together."""
    target = agents.filter(c("f_target_agent") == 1).select("city")
    return ranking.rare_to_other(target, "city", min_count).groupBy("city_grouped").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- customer features and groups

# Edges and labels of the customer bands.
_COUNTS = ([0, 0.1, 1, 2, 4, INF], ["0", "1", "2", "3-4", "5+"])
_RATIOS = ([0, 0.25, 0.5, 0.75, INF], ["<= 25%", "<= 50%", "<=75%", ">75%"])
CUSTOMER_BANDS: dict[str, tuple[list[float], list[str]]] = {
    "total_ape": (
        [0, 1000, 2000, 3000, 5000, 7000, 10000, INF],
        ["1. <=1k", "2. 1-2k", "3. 2-3k", "4. 3-5k", "5. 5-7k", "6. 7-10k", "7. >10k"],
    ),
    "adj_mthly_incm": (
        [500, 1000, 1500, 2000, 3000, 5000, INF],
        ["1. 500-1k", "2. 1-1.5k", "3. 1.5-2k", "4. 2-3k", "5. 3-5k", "6. >5k"],
    ),
    "no_dpnd": ([0, 0.1, 1, 2, INF], ["0", "1", "2", "3+"]),
    "clm_6m_cnt": _COUNTS,
    "clm_6m_ratio": _RATIOS,
    "clm_12m_cnt": _COUNTS,
    "clm_12m_ratio": _RATIOS,
    "ins_typ_count": ([0, 1, 2, INF], ["1", "2", "2+"]),
    "rider_cnt": ([0, 1, 2, 3, 5, INF], ["1", "2", "3", "4-5", "5+"]),
    "cur_age": (
        [0, 24, 30, 35, 40, 45, 50, 55, INF],
        ["<25", "25-30", "31-35", "36-40", "41-45", "46-50", "51-55", "55+"],
    ),
    "gap_to_next_tier": (
        [0, 20000, 50000, 75000, 100000, 150000, 200000, 250000, 300000, INF],
        ["<=20m", "20-50m", "50-75m", "75-100m", "100-150m", "150-200m", "200-250m", "250-300m", "300m+"],
    ),
}
ZERO_FILLED = [
    "no_dpnd", "adj_mthly_incm", "rider_cnt", "clm_6m_cnt", "clm_12m_cnt", "clm_6m_amt", "clm_12m_amt",
    "gap_to_next_tier", "agt_total_ape", "health_base", "inv_base", "health_rider", "riders", "dpnd_child_ind", "dpnd_spouse_ind",
]


def customer_features(
    t: Frames, merged: DataFrame, progress: DataFrame, snapshot: str, rate: Column
) -> DataFrame:
    """Paying customers with product scores, claims, the agent's gap, claim ratios, and bands.

    `progress` is the tier-progress frame of the agents.
    """
    paying = merged.filter(c("total_ape") > 0).select(
        "po_num", "sa_code", "total_ape", "adj_mthly_incm", "no_dpnd", "cur_age", "rider_cnt", "ins_typ_count",
        "dpnd_child_ind", "dpnd_spouse_ind", "vip", "f_agt_inactive", "agent_tier",
    )
    scores = t["score"].filter(c("deployment_approval_status") == "APPROVED").select("po_num", "health_base", "inv_base", "health_rider", "riders")
    claims = customer_plans.owner_claims(t, snapshot, rate).select("po_num", "clm_6m_cnt", "clm_12m_cnt", "clm_6m_amt", "clm_12m_amt")
    gaps = progress.select(c("agt_code").alias("sa_code"), "next_tier", "gap_to_next_tier")
    premium = agent_plans.agent_total_premium(t, snapshot).withColumnRenamed("wa_code", "sa_code")
    rows = joins.star_join(paying, [(scores, ["po_num"]), (claims, ["po_num"]), (gaps, ["sa_code"]), (premium, ["sa_code"])])
    filled = rows.na.fill(0, ZERO_FILLED)
    ratios = filled.withColumns(
        {f"clm_{m}m_ratio": money.safe_ratio(c(f"clm_{m}m_amt"), F.round("total_ape", 4)) for m in (6, 12)}
    )
    labelled = ratios.withColumns(
        {f"{n}_cat": F.coalesce(bands.band(c(n), edges, labels), F.lit("N/A")) for n, (edges, labels) in CUSTOMER_BANDS.items()}
    )
    return labelled.na.fill("N/A", ["agent_tier", "next_tier"])


# Labels of the customer classes.
VIP_LABELS = {"elite": "1. Elite Platinum", "plat": "2. Platinum", "gold": "3. Gold", "silver": "4. Silver"}


def customer_groups(features: DataFrame) -> DataFrame:
    """Marital status, customer class and life group."""
    marital = bands.first_match([(c("dpnd_child_ind") == 1, "1. Married w/ kids"), (c("dpnd_spouse_ind") == 1, "2. Married")], "3. Unknown")
    kids, no_kids = c("mar_stat_cat") == "1. Married w/ kids", c("mar_stat_cat").isin("2. Married", "3. Unknown")
    groups = [
        (no_kids & c("no_dpnd_cat").isin("2", "3+"), "1. Family Guardians"),
        (kids & c("no_dpnd_cat").isin("1", "2", "3+"), "2. Mature Couples"),
        (no_kids & (c("no_dpnd_cat") == "1"), "3. Younger Couples"),
        (c("no_dpnd_cat") == "0", "4. Personal Protection Seekers"),
    ]
    return (
        features.withColumn("mar_stat_cat", marital)
        .withColumn("cus_vip_cat", bands.map_codes(c("vip"), VIP_LABELS, "5. Unknown"))
        .withColumn("group", bands.first_match(groups, "5. Unknown"))
    )


# ---------------------------------------------------------------- customers per agent

# Upper bounds of the customer income classes, in thousands of local currency.
MIX_BOUNDS = [10000, 15000, 20000, 30000, 40000]
MIX_CLASSES = ["F", "E", "D", "C", "B", "A"]


def mix_class(income: Column, bounds: Sequence[float] = MIX_BOUNDS) -> Column:
    rules = [(income < bounds[0], "F"), *[(income <= b, cls) for b, cls in zip(bounds[1:], MIX_CLASSES[1:])]]
    return bands.first_match(rules, "A")


def agent_customers(t: Frames, vip: DataFrame, bounds: Sequence[float] = MIX_BOUNDS) -> DataFrame:
    """Customers of each writing agent with class and income; a missing income becomes twice the
    yearly premium in force."""
    policies = t["policy"].filter(~c("pol_stat_cd").isin("8", "A", "R", "X")).select("pol_num", "po_num")
    written = t["policy_agent"].select("pol_num", c("wa_code").alias("agt_cd"))
    links = joins.join_merged(policies, written, ["pol_num"], "inner").select("agt_cd", "po_num").distinct()
    held = (
        t["policy"].filter(c("pol_stat_cd").isin("1", "3", "5")).groupBy("po_num").agg(money.total(c("tot_ape")).alias("held"))
    )
    people = t["client"].select(c("cli_num").alias("po_num"), c("mthly_incm").cast("int").alias("declared"))
    rows = joins.join_merged(joins.join_merged(links, people, ["po_num"], "inner"), held, ["po_num"])
    rows = joins.join_merged(rows, vip.select("po_num", "vip"), ["po_num"])
    missing = c("declared").isNull() | (c("declared") == 0)
    imputed = (F.coalesce("held", F.lit(0.0)).cast("long") * 2)
    return rows.select(
        "agt_cd",
        "po_num",
        F.coalesce("vip", F.lit("none")).alias("vip_type"),
        bands.flag(missing).alias("missing_income_ind"),
        F.when(missing, imputed).otherwise(c("declared").cast("long")).alias("mthly_incm"),
    ).withColumn("vip_income_class", mix_class(c("mthly_incm"), bounds))


MIX_DIMS = ["sa_status", "tier", "region", "city", "last_12m_income_class", "age_band"]


def agent_customer_mix(customers: DataFrame, levels: DataFrame, vip_names: Mapping[str, str]) -> DataFrame:
    """Customers per class and income class, per agent and then per group of agents."""
    names = {**{f"{v}_count": c("vip_type") == k_ for k_, v in vip_names.items()}}
    names |= {f"class_{cls}_count": c("vip_income_class") == cls for cls in "ABCDEF"}
    per_agent = customers.groupBy("agt_cd").agg(*[F.sum(bands.flag(cond)).alias(n) for n, cond in names.items()])
    rows = per_agent.join(levels.select("agt_cd", *MIX_DIMS), "agt_cd")
    return rows.groupBy(*MIX_DIMS).agg(F.count("agt_cd").alias("agent_count"), *[F.sum(n).alias(n) for n in names])


# ---------------------------------------------------------------- agent segments

SEGMENT_NAMES = ["Top Performers", "High Performers", "The Slackers"]


def agent_performance_segments(agents: DataFrame, kpis: DataFrame) -> DataFrame:
    """Agents by exact quartile cut-offs of customers served and policies sold."""
    rows = agents.select("agt_code", "po_num_count").join(
        kpis.select(c("wa_cd_1").alias("agt_code"), "all_pol_cnt"), "agt_code"
    )
    return agg.assign_segment(rows, ["po_num_count", "all_pol_cnt"], [0.75, 0.25], SEGMENT_NAMES)


