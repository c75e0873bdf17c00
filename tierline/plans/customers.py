"""Customer mart: policy base, value per coverage, lifetime value, client-level frame.

Amounts are converted by `rate`, a column: exchange rate divided by the unit of the ledgers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions import bands, dates, money
from tierline.operators import aggregates as agg
from tierline.operators import joins, ordered, ranking, sets
from tierline.plans import common as k
from tierline.plans.common import Frames, day, exchange_rate
from tierline.sources.sink import forget, stage

c = F.col
YEAR_DAYS = 365.25

# Product types the profiles count, by short name.
PRODUCTS = {
    "term": "Term Life",
    "endow": "Endowment",
    "health_indem": "Health Indemnity",
    "whole": "Whole Life",
    "investment": "Investment",
}


def rate_of(t: Frames, snapshot: str, unit: float = 1000.0) -> Column:
    return exchange_rate(t, snapshot).cast("double") / F.lit(unit)


# Fixed value: activity tier of agents who sold in the last month.
ACTIVE_LAST_MONTH = "1mAA"
STATUS_FLAGS = {
    "f_inforce_ind": k.IN_FORCE,
    "f_lapse_ind": k.LAPSED,
    "f_surr_ind": k.SURRENDERED,
    "f_mature_ind": k.MATURED,
    "f_nottaken_ind": k.NOT_TAKEN,
    "f_ter_ind": k.TERMINATED,
    "f_paid_ind": k.PAID_UP,
}
LATER_STATUS_FLAGS = {**STATUS_FLAGS, "f_inforce_ind": k.IN_FORCE_LATER, "f_paid_ind": k.PAID_UP_LATER}


def served_policies(t: Frames, snapshot: str) -> DataFrame:
    """Policies up to the snapshot with their agents, the servicing agent's flags and their owner's contacts.

    Agents meet the narrow table of policies and agents, contacts the policies alone, and both meet by policy last: what
    is joined on by policy next finds the rows there.
    """
    snap = day(snapshot)
    agents = t["agent"].select(
        c("agt_code").alias("sa_code"),
        c("bank_loc").alias("loc_cd"),
        F.when(
            ~c("comp_prvd_num").isin("04", "05", "34", "36", "97", "98"),
            dates.elapsed(F.coalesce("trmn_dt", snap), c("agt_join_dt"), YEAR_DAYS),
        ).alias("agt_tenure_yrs"),
        bands.flag(c("tier") == "MDRT").alias("mdrt_flag"),
        bands.flag(c("tier") == "TOT").alias("mdrt_tot_flag"),
        bands.flag(c("tier") == "COT").alias("mdrt_cot_flag"),
        bands.flag(c("agent_tier") == ACTIVE_LAST_MONTH).alias("active_1m_flag"),
    )
    contacts = t["client"].select(
        c("cli_num").alias("po_num"), c("email_addr").isNotNull().alias("_email"), c("mobl_phon_num").isNotNull().alias("_mobile")
    )
    policies = t["policy"].filter(c("pol_eff_dt") <= snap).select(
        "pol_num", "po_num", "pol_eff_dt", "pol_trmn_dt", "pol_stat_cd", "pmt_mode", "dist_chnl_cd", "lst_pmt_mthd"
    )
    return joins.join_merged(joins.join_merged(policies, contacts, ["po_num"]), t["policy_agent"].join(agents, "sa_code", "left"), ["pol_num"])


COVERAGE_COLUMNS = ["pol_num", "cvg_num", "cvg_eff_dt", "plan_code", "cvg_typ", "cvg_prem", "face_amt", "prem_dur"]


def base_rows(rows: DataFrame, snapshot: str, families: Mapping[str, Sequence[str]], also: Sequence[str] = ()) -> DataFrame:
    """Columns of the policy base from policies beside their coverages, and the columns `also`."""
    snap = day(snapshot)
    years = F.floor(dates.elapsed(snap, c("cvg_eff_dt"), YEAR_DAYS)).cast("int")
    dur = c("prem_dur").cast("int")
    lasted = dates.elapsed(F.coalesce("pol_trmn_dt", snap), c("pol_eff_dt"), YEAR_DAYS)
    tests = {
        **{n: f"pol_stat_cd in ({', '.join(repr(x) for x in codes)})" for n, codes in families.items()},
        "f_same_agent": "wa_code = sa_code",
        "f_cheque": "lst_pmt_mthd = 'CHEQUE'",
        "f_cash": "lst_pmt_mthd = 'CASH'",
        "f_auto": "lst_pmt_mthd = 'TRANSFER'",
        "valid_email": "_email",
        "valid_mobile": "_mobile",
    }
    flags = [bands.flag(test).alias(n) for n, test in tests.items()]
    return rows.select(
        "pol_num", "po_num", "cvg_num", "cvg_eff_dt", "plan_code", "cvg_typ", "cvg_prem", "face_amt",
        "dist_chnl_cd", "pol_stat_cd", "pmt_mode", "loc_cd", "ins_typ_desc",
        "agt_tenure_yrs", "mdrt_flag", "mdrt_tot_flag", "mdrt_cot_flag", "active_1m_flag",
        dur.alias("prem_dur"),
        F.least(years, dur).alias("prem_dur_pre"),
        (dur - F.least(years, dur)).alias("prem_dur_post"),
        *flags,
        F.floor(lasted).cast("int").alias("inforce_year"),
        *also,
    )


def policy_base(t: Frames, snapshot: str, families: Mapping[str, Sequence[str]] = STATUS_FLAGS) -> DataFrame:
    """Coverages with policy status families, servicing-agent flags and payment-method flags."""
    cov = t["coverage"].filter(c("cvg_eff_dt") <= day(snapshot)).select(*COVERAGE_COLUMNS)
    typed = joins.join_merged(cov, t["plan"].select("plan_code", "ins_typ_desc"), ["plan_code"])
    # The wide side is not moved by plan; coverages of unknown policies drop out where it meets the narrow one.
    return base_rows(joins.join_merged(served_policies(t, snapshot), typed, ["pol_num"]), snapshot, families)


# Distribution channel codes by kind, and the margin of channel 09.
BANK_CHANNELS = [
    "03", "10", "14", "16", "17", "18", "19", "22", "23", "24", "25", "29", "30", "31", "32", "33",
    "39", "41", "44", "47", "49", "51", "52", "53",
]
AGENCY_CHANNELS = ["01", "02", "08", "50", "*"]
DIRECT_CHANNELS = ["05", "06", "07", "34", "36"]
AFFINITY_CHANNELS = ["48"]
FIXED_MARGIN_CHANNEL = "09"
FIXED_MARGIN = -1.34041044648343
UNVALUED_STATUSES = ["6", "8"]


# Bank locations by the beginning of their code, each with the margin it earns.
BANK_MARGINS = {"TCB": "banca_tcb", "SAG": "banca_scb"}


class MarginRule(NamedTuple):
    """Coverages of some channels (None: any), with or without a bank location, that earn one role's margin of
    their plan or a fixed one. `location` is the beginning of the code, "" any location, None no location."""

    location: str | None
    channels: Sequence[str] | None
    role: str | None
    fixed: float | None = None

    def applies(self, loc: Column, channel: Column) -> Column:
        where = loc.isNull() if self.location is None else loc.startswith(self.location)
        return where if self.channels is None else where & channel.isin(list(self.channels))


def margin_rules(banks: Mapping[str, str] = BANK_MARGINS) -> list[MarginRule]:
    """The rules in order of precedence; the last one of each kind of location leaves no coverage out."""
    return [
        MarginRule(None, BANK_CHANNELS, "banca_other_banks"),
        MarginRule(None, AFFINITY_CHANNELS, "other_channel_affinity"),
        MarginRule(None, AGENCY_CHANNELS, "agency"),
        MarginRule(None, DIRECT_CHANNELS, "dmtm"),
        MarginRule(None, [FIXED_MARGIN_CHANNEL], None, FIXED_MARGIN),
        MarginRule(None, None, "other_channel"),
        MarginRule("", ["*"], "agency"),
        *(MarginRule(prefix, None, role) for prefix, role in banks.items()),
        MarginRule("", None, "other_channel"),
    ]


def same_value(one: str, other: str) -> Column:
    """Equal and known, as a condition that Spark does not take for a key to spread the rows by."""
    return (c(one) >= c(other)) & (c(one) <= c(other))


def join_margin(rows: DataFrame, margins: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Left join of the margin in the row's `margin_role`, from columns `nbv_margin_<role>`; a row of `margins` without a
    margin in that role is not met.

    The roles stay side by side: one row per role would be eight times the rows. Many margins fit in a small file, and
    Spark does not know how far an array of dates unfolds, so its estimate is too low to broadcast by: the sides are merged,
    by the first key alone, so that rows already spread by it stay where they are.
    """
    prefix = "nbv_margin_"
    roles = [n for n in margins.columns if n.startswith(prefix)]
    side = margins.select(*keys, *roles).withColumnsRenamed({n: f"_r_{n}" for n in (*keys, *roles)})
    margin = bands.first_match([(c("margin_role") == n.removeprefix(prefix), c(f"_r_{n}")) for n in roles])
    met = margin.isNotNull() & (c(keys[0]) == c(f"_r_{keys[0]}"))
    for key in keys[1:]:
        met = met & same_value(key, f"_r_{key}")
    return rows.join(side.hint("merge"), met, "left").withColumn(name, margin).drop(*side.columns)


def with_margin_role(rows: DataFrame, rules: Sequence[MarginRule]) -> DataFrame:
    """`margin_role` and `_fixed`, the fixed margin, of the first rule that applies to loc_cd and dist_chnl_cd, without a join."""
    tests = [(rule.applies(c("loc_cd"), c("dist_chnl_cd")), rule) for rule in rules]
    return rows.withColumns(
        {
            "margin_role": bands.first_match([(test, rule.role) for test, rule in tests]),
            "_fixed": bands.first_match([(test, rule.fixed) for test, rule in tests]).cast("double"),
        }
    )


def with_plan_margin(rows: DataFrame, static: DataFrame, dated: DataFrame, name: str) -> DataFrame:
    """The plan's own margin in the row's `margin_role`, else the quarter's: each meets the rows once."""
    own = join_margin(rows, static, ["plan_code"], "_own")
    found = join_margin(own, dated, ["plan_code", "effective_qtr"], "_of_quarter")
    return found.withColumn(name, joins.lookup_coalesce(c("_own"), c("_of_quarter"))).drop("_own", "_of_quarter")


def with_margin(
    rows: DataFrame, static: DataFrame, dated: DataFrame, rules: Sequence[MarginRule], name: str = "nbv_margin"
) -> DataFrame:
    """Margin of each row (plan_code, effective_qtr, loc_cd, dist_chnl_cd): of the first rule that applies, the
    plan's own margin in that role, else the quarter's, and null where there is neither.

    `static` has a row per plan, `dated` one per plan and quarter, both with a column per role. The rules are
    evaluated per row without a join; the margins meet the rows once each, by plan, quarter and role.
    """
    found = with_plan_margin(with_margin_role(rows, rules), static, dated, "_of_plan")
    return found.withColumn(name, joins.lookup_coalesce(c("_fixed"), c("_of_plan"))).drop("_fixed", "_of_plan", "margin_role")


def coverage_value(
    t: Frames,
    snapshot: str,
    rate: Column,
    rules: Sequence[MarginRule] | None = None,
    families: Mapping[str, Sequence[str]] = STATUS_FLAGS,
) -> DataFrame:
    """New-business value, annual premium and face amount per coverage, and its channel.

    Policies are wide, and their coverages have to meet the plans. So the policies stay where they are: the coverages
    take only the margin role of their policy along to the plans, and come back to it. What is sent is never wide,
    and the rows end up by policy. Policies and priced coverages are written, which ends the shuffles before them.
    """
    valued = served_policies(t, snapshot).filter(~c("pol_stat_cd").isin(UNVALUED_STATUSES))
    policies = with_margin_role(stage(valued, "policies"), rules or margin_rules())
    # A policy that comes twice may have two roles, and one of a fixed margin has none.
    roles = policies.select("pol_num", "margin_role").repartition("pol_num").distinct()
    quarter = dates.lagged_quarter(c("cvg_eff_dt"))
    cov = t["coverage"].filter(c("cvg_eff_dt") <= day(snapshot)).select(*COVERAGE_COLUMNS)
    cov = joins.join_merged(cov, roles, ["pol_num"], "inner").withColumn("effective_qtr", quarter)
    typed = joins.join_merged(cov, t["plan"].select("plan_code", "ins_typ_desc"), ["plan_code"])
    priced = with_plan_margin(typed, t["plan_margin"], t["margin_quarter"], "_of_plan").drop("effective_qtr")
    back = stage(priced.withColumns({"_role": F.coalesce("margin_role", F.lit("")), "_pol": c("pol_num")}).drop("pol_num", "margin_role"), "coverages")
    own = F.coalesce("margin_role", F.lit(""))
    met = (c("pol_num") == c("_pol")) & same_value("_own_role", "_role")
    beside = policies.withColumn("_own_role", own).join(back.hint("merge"), met, "left")
    found = base_rows(beside, snapshot, families, ["_fixed", "_of_plan"]).withColumn("effective_qtr", quarter)
    rows = found.withColumn("nbv_margin", joins.lookup_coalesce(c("_fixed"), c("_of_plan"))).drop("_fixed", "_of_plan")
    channel = (
        F.when(c("dist_chnl_cd").isin(AGENCY_CHANNELS), "Agency")
        .when(c("dist_chnl_cd").isin(DIRECT_CHANNELS), "DMTM")
        .otherwise(F.substring("loc_cd", 1, 3))
    )
    return (
        rows.withColumn("_rate", rate)
        .withColumns(
            {
                "plan_nbv": c("cvg_prem") / c("_rate") * c("nbv_margin"),
                "coverage_ape": c("cvg_prem") * F.lit(12.0) / c("pmt_mode") / c("_rate"),
                "coverage_fa": c("face_amt") / c("_rate"),
                "annual_flag": bands.flag(c("pmt_mode") == 12),
                "channel": channel,
            }
        )
        .drop("_rate", "cvg_prem", "face_amt")
    )


# What `coverage_value` writes.
VALUE_STAGES = ("policies", "coverages")

FLAG_COLUMNS = [*STATUS_FLAGS, "f_same_agent", "mdrt_flag", "mdrt_tot_flag", "mdrt_cot_flag", "active_1m_flag", "annual_flag", "valid_email", "valid_mobile"]
COUNT_COLUMNS = ["f_cash", "f_cheque", "f_auto"]


def policy_level(value: DataFrame, products: Mapping[str, str] = PRODUCTS) -> DataFrame:
    """One row per owner and policy. All owner measures follow from this frame: distinct counts of
    policies become sums, and a hot owner arrives as one row per policy."""
    four = "sum(cast({} as decimal(18,4)))".format
    protection = f"case when ins_typ_desc in ({products['term']!r}, {products['whole']!r}) then coverage_fa end"
    measures = {
        "first_eff": "min(cvg_eff_dt)",
        **{n: f"max({n})" for n in FLAG_COLUMNS},
        **{n: f"sum({n})" for n in COUNT_COLUMNS},
        **{f"has_{n}": f"max(case when ins_typ_desc = {v!r} then 1 else 0 end)" for n, v in products.items()},
        "tenure_sum": four("agt_tenure_yrs"),
        "tenure_n": "count(agt_tenure_yrs)",
        "inforce_year": "max(inforce_year)",
        **{n: four(n) for n in ("coverage_ape", "plan_nbv", "coverage_fa")},
        "rider_ape": four("case when cvg_typ = 'R' then coverage_ape end"),
        "rider_cnt": "count(case when cvg_typ = 'R' then cvg_num end)",
        "protection_fa": four(protection),
        **{n: f"min({n})" for n in ("prem_dur", "prem_dur_pre", "prem_dur_post")},
    }
    # The channel is the same on all rows of a policy. As a grouping column, not an aggregate of text,
    # it leaves the grouping hash-based.
    return value.groupBy("po_num", "pol_num", "channel").agg(*[F.expr(text).alias(n) for n, text in measures.items()])


def customer_channel(policies: DataFrame, first_of: Sequence[str] = ("Agency", *BANK_MARGINS)) -> DataFrame:
    """The first of the given channels (Agency, then the banks) that a policy came by, else that of the first
    policy."""

    def seen(label: str) -> Column:
        return F.max(bands.flag(c("channel") == label)) == 1

    first = F.min_by("channel", F.struct("first_eff", "pol_num"))
    label = F.coalesce(*[F.when(seen(name), name) for name in first_of], first)
    return policies.groupBy("po_num").agg(label.alias("channel_final"))


# Lower premium bounds of the customer classes.
VIP_BOUNDS = {"elite": 12961.76, "plat": 6480.88, "gold": 2808.38, "silver": 864.12}


def vip_label(ape: Column, long_policies: Column) -> Column:
    """Class by premium; silver also needs a long-held policy."""
    return (
        F.when(ape >= VIP_BOUNDS["elite"], "elite")
        .when(ape >= VIP_BOUNDS["plat"], "plat")
        .when(ape >= VIP_BOUNDS["gold"], "gold")
        .when((ape >= VIP_BOUNDS["silver"]) & (long_policies >= 1), "silver")
    )


def vip_segment(policies: DataFrame, long_years: int = 10) -> DataFrame:
    sums = policies.groupBy("po_num").agg(
        F.sum("coverage_ape").cast("double").alias("total_ape"),
        F.count("pol_num").alias("pol_cnt"),
        F.sum(bands.flag(c("inforce_year") >= long_years)).alias("long_pol_cnt"),
    )
    return sums.withColumn("vip", F.coalesce(vip_label(c("total_ape"), c("long_pol_cnt")), F.lit("none")))


def approved_claims(t: Frames, snapshot: str, rate: Column) -> DataFrame:
    rows = t["claim"].filter((c("clm_stat_code") == "A") & (c("clm_aprov_dt") <= day(snapshot)))
    sums = rows.groupBy("pol_num").agg(money.total(c("clm_aprov_amt"), 4).alias("_amt"))
    return sums.select("pol_num", (c("_amt") / rate).alias("claim_amount"))


LTV_COLUMNS = ["pol_ltv", "pol_ltv_pre", "pol_ltv_post", "mod_pol_ltv", "mod_pol_ltv_pre", "mod_pol_ltv_post"]


def with_policy_ltv(policies: DataFrame, t: Frames, snapshot: str, rate: Column) -> DataFrame:
    """Lifetime value of each policy: by premium years, and split into past and future with approved
    claims and the lapse score taken off."""
    scores = [
        (approved_claims(t, snapshot, rate), ["pol_num"]),
        (t["lapse"].select("pol_num", "lapse_score", "next_due_decile"), ["pol_num"]),
        (t["early_lapse"].select("pol_num", "p_1", c("decile").alias("early_lapse_decile")), ["pol_num"]),
    ]
    # A row per policy each: merged, whatever the size of the files they come from.
    rows = joins.star_join(policies, [(f.hint("merge"), on) for f, on in scores])
    stays = F.lit(1.0) - F.coalesce("lapse_score", "p_1", F.lit(0.0))
    paid = F.try_divide(c("prem_dur_pre").cast("double"), c("prem_dur").cast("double"))
    claims = F.coalesce("claim_amount", F.lit(0.0))
    nbv = c("plan_nbv").cast("double")
    out = rows.withColumns(
        {
            "claim_amount": claims,
            "lapse_decile": F.least("next_due_decile", "early_lapse_decile"),
            "_stays": stays,
            "years_ltv": nbv * c("prem_dur") * stays,
            "years_ltv_pre": nbv * c("prem_dur_pre") * stays,
            "years_ltv_post": nbv * c("prem_dur_post") * stays,
            "pol_ltv": nbv,
            "pol_ltv_pre": nbv * paid,
            "pol_ltv_post": F.coalesce(nbv * (F.lit(1.0) - paid), F.lit(0.0)),
        }
    )
    return out.withColumns(
        {f"mod_{n}": (c(n) - c("claim_amount")) * c("_stays") for n in ("pol_ltv", "pol_ltv_pre", "pol_ltv_post")}
    ).drop("_stays")


def policy_ltv(t: Frames, snapshot: str, rate: Column, products: Mapping[str, str] = PRODUCTS) -> DataFrame:
    rows = with_policy_ltv(policy_level(coverage_value(t, snapshot, rate), products), t, snapshot, rate)
    return rows.select(
        "pol_num", "po_num",
        c("coverage_ape").cast("double").alias("coverage_ape"),
        c("plan_nbv").cast("double").alias("plan_nbv"),
        money.safe_ratio(c("plan_nbv"), c("coverage_ape")).alias("cli_nbv_margin"),
        F.coalesce(c("rider_ape").cast("double"), F.lit(0.0)).alias("rider_ape"), "rider_cnt",
        "prem_dur", "prem_dur_pre", "claim_amount",
        "years_ltv", "years_ltv_pre", "years_ltv_post", *LTV_COLUMNS, "early_lapse_decile", "lapse_decile",
    )


def decile_table(df: DataFrame, n: int, measure: str, key: str, means: Sequence[str]) -> DataFrame:
    """Rows and mean values per exact decile of `measure`, largest first."""
    kept = stage(df.select(key, measure, *[m for m in means if m != measure]))
    ranked = ordered.ntile_global(kept, n, [(measure, "desc"), (key, "asc")], "decile")
    return ranked.groupBy("decile").agg(F.count(key).alias("n"), *[money.mean(c(m), 4).alias(f"mean_{m}") for m in means])


def _owner_sums() -> list[Column]:
    ltv = {n: f"pol_ltv{n.removeprefix('cli_ltv')}" for n in ("cli_ltv", "cli_ltv_pre", "cli_ltv_post")}
    measures = {
        "coverage_ape": "cast(sum(coverage_ape) as double)",
        "plan_nbv": "cast(sum(plan_nbv) as double)",
        "rider_ape": "coalesce(cast(sum(rider_ape) as double), 0.0d)",
        "rider_cnt": "sum(rider_cnt)",
        "min_prem_dur": "min(prem_dur)",
        **{n: money.total_text(of, 4) for n, of in ltv.items()},
        **{f"{n}_mod": money.total_text(f"mod_{of}", 4) for n, of in ltv.items()},
        "claim_amount": money.total_text("claim_amount", 4),
        "early_lapse_decile": "min(early_lapse_decile)",
        "lapse_decile": "min(lapse_decile)",
    }
    return [F.expr(text).alias(n) for n, text in measures.items()]


def customer_ltv(t: Frames, snapshot: str, rate: Column, products: Mapping[str, str] = PRODUCTS) -> DataFrame:
    """Lifetime value per owner, customers of the agency channel only."""
    value = policy_level(coverage_value(t, snapshot, rate), products)
    policies = stage(value, "policy_level")
    forget(value, VALUE_STAGES)
    sums = with_policy_ltv(policies, t, snapshot, rate)
    owners = sums.groupBy("po_num").agg(*_owner_sums())
    agency = customer_channel(policies).filter(c("channel_final") == "Agency")
    return owners.join(agency, "po_num").withColumn("cli_nbv_margin", money.safe_ratio(c("plan_nbv"), c("coverage_ape")))


# ---------------------------------------------------------------- owner-level inputs


def first_second_product(t: Frames) -> DataFrame:
    """First and second policy of each owner side by side and the years between them."""
    plans = t["plan"].select("plan_code", "ins_typ_desc")
    sold = t["policy"].select("po_num", "pol_num", "pol_eff_dt", "tot_ape")
    rows = joins.join_merged(sold, t["policy_plan"].select("pol_num", "plan_code"), ["pol_num"], "inner")
    rows = joins.join_merged(rows, plans, ["plan_code"])
    order = [("pol_eff_dt", "asc"), ("pol_num", "asc")]
    cols = ["plan_code", "pol_eff_dt", "tot_ape", "ins_typ_desc"]
    out = agg.pivot_first_n(rows, "po_num", order, 2, cols, {"tot_ape": "int"})
    years = dates.elapsed(c("pol_eff_dt_2"), c("pol_eff_dt_1"), YEAR_DAYS)
    return out.withColumn("yr_2nd_prod", F.floor(years).cast("int"))


# Agent provider codes.
OWN_AGENT, COLLECTOR, MANAGERS = "01", "04", ["97", "98"]
# Relation by the provider of an agent that is still there.
RELATION = {"01": "Original Agent", "04": "Orphaned-Collector", "97": "Orphaned-Agent is SM", "98": "Orphaned-Agent is SM"}


def agent_assignment(t: Frames) -> DataFrame:
    """Relation of each in-force policy to its servicing agent, and owners left unassigned."""
    who = t["agent"].select("agt_code", "comp_prvd_num", "trmn_dt")
    held = joins.join_merged(t["policy"].filter(c("pol_stat_cd").isin(k.IN_FORCE)), t["policy_agent"], ["pol_num"], "inner")
    rows = joins.join_roles(
        held.withColumns({"_wa": c("wa_code"), "_sa": c("sa_code")}),
        who, "agt_code", {"_wa": "wa", "_sa": "sa"}, ["comp_prvd_num", "trmn_dt"],
    ).filter(c("wa_comp_prvd_num").isin(OWN_AGENT, *MANAGERS) & c("sa_comp_prvd_num").isin(OWN_AGENT, COLLECTOR, *MANAGERS))
    serving = bands.map_codes(c("sa_comp_prvd_num"), RELATION)
    own = serving == RELATION[OWN_AGENT]
    relation = F.when(c("sa_trmn_dt").isNotNull(), "Orphaned").when(own & (c("sa_code") != c("wa_code")), "Reassigned Agent").otherwise(serving)
    return rows.select("pol_num", "po_num", relation.alias("cus_agt_rltnshp"))


def unassigned_owners(t: Frames) -> DataFrame:
    assigned = c("cus_agt_rltnshp").isin("Original Agent", "Reassigned Agent")
    return agent_assignment(t).groupBy("po_num").agg(F.max(F.when(assigned, 0).otherwise(1)).alias("unassigned_ind"))


def inactive_owners(t: Frames) -> DataFrame:
    """Owners without any policy in force and the date of their last termination."""
    return (
        t["policy"]
        .groupBy("po_num")
        .agg(
            F.max(bands.flag(c("pol_stat_cd").isin(k.IN_FORCE))).alias("f_inforce_ind"),
            F.max("pol_trmn_dt").alias("last_termination_date"),
        )
        .filter(c("f_inforce_ind") == 0)
    )


def next_maturity(t: Frames, snapshot: str) -> DataFrame:
    return t["policy"].filter(c("xpry_dt") >= day(snapshot)).groupBy("po_num").agg(F.min("xpry_dt").alias("min_mat_date"))


def owner_is_agent(t: Frames) -> DataFrame:
    written = joins.join_merged(t["policy"].select("pol_num", "po_num"), t["policy_agent"].select("pol_num", "wa_code"), ["pol_num"])
    return joins.identity_match(written, t["client"], t["agent"])


def dependents(t: Frames) -> DataFrame:
    return joins.dependent_flags(t["insured"], "po_num", "rel_to_insrd")


# Traffic sources that are not people.
EXCLUDED_SOURCES = ["5", "7", "8", "9"]


def digital_activity(t: Frames, cutoff: str) -> DataFrame:
    """Latest activation, first use and last repeat use per customer, all up to the cut-off.

    Users who never came back have no last use and drop out.
    """
    end = day(cutoff)
    hits = t["hit"].filter(~c("hit_source").isin(EXCLUDED_SOURCES))
    until = F.to_timestamp_ntz(F.concat(F.lit(cutoff), F.lit(" 23:59:59.999999")))
    used = ranking.first_and_repeat(hits, "login_id", "date_time", until, "reg_ts", "last_ts").select(
        "login_id", F.to_date("reg_ts").alias("reg_dt"), F.to_date("last_ts").alias("lst_login_dt")
    )
    known = t["account"].join(used, "login_id").filter((c("lst_login_dt") <= end) & (c("activation_date") <= end))
    order = [("activation_date", "desc"), ("lst_login_dt", "desc"), ("login_id", "asc")]
    return ranking.latest_per_key(known, ["cli_num"], order).select("cli_num", "activation_date", "reg_dt", "lst_login_dt")


# Fixed value: the page whose visits are portal logins.
LOGIN_PAGE = "/portfolio/policies"


def portal_activity(t: Frames, cutoff: str, servers: Sequence[str]) -> DataFrame:
    """First login to the customer portal and last repeat login per customer, both up to the cut-off.

    A login is a visit of the policies page on one of `servers` by a known visitor; excluded hits and sources do not
    count. Users who never came back drop out. Of several accounts the one that joined last counts.
    """
    end = day(cutoff)
    until = F.to_timestamp_ntz(F.concat(F.lit(cutoff), F.lit(" 23:59:59.999999")))
    logins = t["portal_hit"].filter(
        (c("exclude_hit") == 0) & ~c("hit_source").isin(EXCLUDED_SOURCES) & c("visitor").isNotNull() & c("login_id").isNotNull()
        & (c("page") == LOGIN_PAGE) & c("server").isin(list(servers))
    )
    used = ranking.first_and_repeat(logins, "login_id", "date_time", until, "joined", "last").select(
        c("login_id").alias("acc_id"), F.to_date("joined").alias("cws_joint_dt"), F.to_date("last").alias("cws_lst_login_dt")
    )
    known = t["portal_account"].join(used, "acc_id").filter((c("cws_lst_login_dt") <= end) & (c("cws_joint_dt") <= end))
    order = [("cws_joint_dt", "desc"), ("cws_lst_login_dt", "desc"), ("acc_id", "asc")]
    return ranking.latest_per_key(known, ["cli_num"], order).select("cli_num", "cws_joint_dt", "cws_lst_login_dt")


def propensity(t: Frames) -> DataFrame:
    """Least decile of any product model per owner: of the models for existing customers, united with those for
    new ones. An owner in both takes the least."""
    existing = ["decile_inv", "decile_ci", "decile_lp", "decile_lt", "decile_acc", "decile_med"]
    new = ["ci_decile", "invst_decile", "lt_decile"]
    both = sets.union_scores(
        [(t["existing_score"].withColumnRenamed("cli_num", "po_num"), existing), (t["new_score"], new)], "po_num", "min_decile"
    )
    return both.groupBy("po_num").agg(F.min("min_decile").alias("min_decile"))


def recent_sales(t: Frames, snapshot: str, months: int = 6) -> DataFrame:
    """Policies sold in the months before the snapshot's, with their value: owner, day, premium, new-business value."""
    in_time = dates.month_offset(c("pol_eff_dt"), day(snapshot)).between(-months, -1)
    sales = t["policy"].filter(in_time).select("po_num", "pol_num", "pol_eff_dt", "tot_ape")
    sales = joins.join_merged(sales, t["policy_plan"].select("pol_num", "plan_code"), ["pol_num"])
    sales = joins.join_merged(sales, t["plan_margin"].select("plan_code", "nbv_margin_agency"), ["plan_code"])
    return sales.select("po_num", "pol_num", "pol_eff_dt", "tot_ape", (c("tot_ape") * c("nbv_margin_agency")).alias("nbv"))


def owner_leads(t: Frames, snapshot: str, rate: Column) -> DataFrame:
    """Leads of the campaign per owner, and the sales that followed one: each sale is led by the last lead up to its
    day, so a sale before the owner's first lead is none of the campaign's."""
    leads = t["campaign"].select(c("tgt_cust_id").alias("po_num"), "lead_dt")
    sales = ordered.asof_last(recent_sales(t, snapshot), leads, ["po_num"], "pol_eff_dt", "lead_dt", "led_by")
    led = sales.filter(c("led_by").isNotNull()).groupBy("po_num").agg(
        F.count("*").alias("conversion"),
        F.sum(money.exact(c("tot_ape"))).alias("_ape"),
        F.sum(money.exact(c("nbv"), 4)).alias("_nbv"),
    )
    asked = leads.groupBy("po_num").agg(F.count("*").alias("lead_cnt"))
    return joins.join_merged(asked, led, ["po_num"]).select(
        "po_num", "lead_cnt", F.coalesce("conversion", F.lit(0)).alias("conversion"),
        (c("_ape").cast("double") / rate).alias("conversion_ape"), (c("_nbv").cast("double") / rate).alias("conversion_nbv"),
    )


def owner_payments(t: Frames, rate: Column) -> DataFrame:
    """Premium paid and the largest face amount of a policy, per owner."""
    faces = t["coverage"].groupBy("pol_num").agg(money.total(c("face_amt")).alias("face"))
    return (
        joins.join_merged(t["policy"], faces, ["pol_num"])
        .groupBy("po_num")
        .agg(money.total(c("tot_ape")).alias("paid"), F.max("face").alias("face"))
        .select("po_num", (c("paid") / rate).alias("transaction_usd"), (c("face") / rate).alias("tot_face_amt_usd"))
    )


RECENCY_BANDS = {
    "lst_termination_mth": ("f_trmn", [(0, 6), (6, 12), (12, 18)]),
    "lst_purchase_mth": ("f_purchase", [(0, 6), (6, 12), (12, 18)]),
    "next_mat_date_mth": ("f_mat", [(0, 12), (12, 24)]),
}


def recency_columns() -> dict[str, Column]:
    return {
        f"{name}_{low}_{high}m": bands.flag(f"{col} >= {low} and {col} < {high}")
        for col, (name, spans) in RECENCY_BANDS.items()
        for low, high in spans
    }


def recency_flags(t: Frames, snapshot: str) -> DataFrame:
    """Months since last purchase and termination and to next maturity, in bands, per owner."""
    snap = day(snapshot)
    live = F.max(bands.flag(c("pol_stat_cd").isin(k.IN_FORCE)))
    days = (
        t["policy"]
        .groupBy("po_num")
        .agg(
            F.max(F.when(c("pol_eff_dt") <= snap, c("pol_eff_dt"))).alias("lst_eff_dt"),
            F.when(live == 0, F.max("pol_trmn_dt")).alias("last_termination_date"),
            F.min(F.when(c("xpry_dt") >= snap, c("xpry_dt"))).alias("min_mat_date"),
        )
        .filter(c("lst_eff_dt").isNotNull())
    )
    months = days.select(
        "po_num",
        dates.elapsed(snap, c("lst_eff_dt"), 30.0).alias("lst_purchase_mth"),
        dates.elapsed(snap, c("last_termination_date"), 30.0).alias("lst_termination_mth"),
        dates.elapsed(c("min_mat_date"), snap, 30.0).alias("next_mat_date_mth"),
    )
    return months.withColumns(recency_columns())


# ---------------------------------------------------------------- client level

INCOME_FLOOR, INCOME_CAP = 864.0, 20000.0
# Cities and marketing segments with a flag of their own.
CITIES = {"f_HCM": "Hồ Chí Minh", "f_HN": "Hà Nội", "f_DN": "Đà Nẵng"}
SEGMENTS = {
    "f_adult_self_insured": "Adult Self Insured",
    "f_family": "Family",
    "f_family_wkids": "Family with Kids",
    "f_empty_nest": "Empty Nester",
    "f_undefined_segment": "Undefined Segmentation",
}


def adjusted_income(income: Column, tenure: Column) -> Column:
    """Income grown by inflation over the tenure; negative becomes a floor, the top is capped."""
    grown = money.inflate(income, tenure)
    return F.when(grown < 0, F.lit(INCOME_FLOOR)).when(grown > INCOME_CAP, F.lit(INCOME_CAP)).otherwise(grown)


def product_types(t: Frames, snapshot: str) -> DataFrame:
    """Distinct product types per owner, from the three columns this takes."""
    snap = day(snapshot)
    mine = t["policy"].filter((c("pol_eff_dt") <= snap) & ~c("pol_stat_cd").isin(UNVALUED_STATUSES)).select("pol_num", "po_num")
    held = t["coverage"].filter(c("cvg_eff_dt") <= snap).select("pol_num", "plan_code")
    rows = joins.join_merged(held, t["plan"].select("plan_code", "ins_typ_desc"), ["plan_code"], "inner")
    rows = joins.join_merged(rows, mine, ["pol_num"], "inner")
    return (
        rows.filter(c("ins_typ_desc").isNotNull())
        .select("po_num", "ins_typ_desc")
        .distinct()
        .groupBy("po_num")
        .agg(F.count("*").alias("ins_typ_count"))
    )


def client_level(
    t: Frames,
    snapshot: str,
    digital_cutoff: str,
    rate: Column,
    products: Mapping[str, str] = PRODUCTS,
    long_years: int = 10,
    portal_servers: Sequence[str] = (),
    cities: Mapping[str, str] = CITIES,
    segments: Mapping[str, str] = SEGMENTS,
    cut: bool = True,
) -> DataFrame:
    """One wide row per agency customer. Incomes are converted once, here; `rate` gives local currency.

    Coverages shrink to policies once (written to the shared folder), policies to owners once; the
    other inputs are one row per owner and join on the owner.

    With `cut` they join in groups, and the owners are written before each: no plan and no task holds all of them.
    Without it a reader of a few columns leaves out what only the others need. The rows are the same.
    """
    snap = day(snapshot)
    value = policy_level(coverage_value(t, snapshot, rate), products)
    policies = stage(value, "policy_level")
    forget(value, VALUE_STAGES)
    rows = with_policy_ltv(policies, t, snapshot, rate)
    held = {n.removeprefix("f_").removesuffix("_ind"): n for n in STATUS_FLAGS}
    owners = rows.groupBy("po_num").agg(
        *_owner_sums(),
        F.min("first_eff").alias("first_pol_eff_dt"),
        F.count("pol_num").alias("pol_count"),
        F.min("next_due_decile").alias("next_due_lapse_decile"),
        *[F.expr(f"sum(has_{n})").alias(f"{n}_pol") for n in products],
        *[F.expr(f"sum({flag_name})").alias(f"{n}_pol") for n, flag_name in held.items()],
        *[F.expr(f"max({n})").alias(n) for n in FLAG_COLUMNS if n not in STATUS_FLAGS],
        *[F.expr(f"sum({n})").alias(n) for n in COUNT_COLUMNS],
        (F.try_divide(F.sum("tenure_sum").cast("double"), F.sum("tenure_n").cast("double"))).alias("agt_tenure_yrs"),
        F.sum(bands.flag(c("inforce_year") >= long_years)).alias("long_pol_cnt"),
        F.sum("protection_fa").cast("double").alias("protection_fa"),
        F.sum("coverage_fa").cast("double").alias("protection_fa_all"),
    )
    types = product_types(t, snapshot)
    agency = customer_channel(policies).filter(c("channel_final") == "Agency")
    people = t["client"].select(
        c("cli_num").alias("po_num"), (c("mthly_incm") / rate).alias("mthly_incm"), "customer_segment", "cur_age", "sex_code", "no_dpnd", "city_cd"
    )
    first_two = first_second_product(t).select("po_num", "ins_typ_desc_1", "ins_typ_desc_2", "tot_ape_1", "yr_2nd_prod")
    digital = digital_activity(t, digital_cutoff).withColumnRenamed("cli_num", "po_num")
    cities_of = t["location"].select(c("loc_cd").alias("city_cd"), "city")
    people = people.join(cities_of, "city_cd", "left")
    survey = t["income_survey"].groupBy(c("cli_num").alias("po_num")).agg(F.max("avg_mth_income").alias("max_income"))
    portal = portal_activity(t, digital_cutoff, portal_servers).withColumnRenamed("cli_num", "po_num")
    scores = t["score"].select("po_num", F.least("health_base", "inv_base", "health_rider", "riders").alias("min_score"))
    recency = recency_flags(t, snapshot)
    # All have a row per owner, as the first has, and grow with the owners: merged whatever Spark's estimate is.
    groups = [
        [types, scores, propensity(t), people, survey],
        [first_two, digital, portal, recency, unassigned_owners(t)],
        [owner_is_agent(t), owner_payments(t, rate), dependents(t), owner_leads(t, snapshot, rate)],
    ]
    joined = joins.join_merged(owners, agency, ["po_num"], "inner")
    for sides in groups:
        if cut:
            kept = stage(joined, "owners")
            forget(joined, ["policy_level", "owners"])
            joined = kept
        joined = joins.star_join(joined, [(f.hint("merge"), ["po_num"]) for f in sides])
    tenure = dates.elapsed(snap, c("first_pol_eff_dt"), YEAR_DAYS)
    ordinal = {"1st": "ins_typ_desc_1", "2nd": "ins_typ_desc_2"}
    cut = day(digital_cutoff)
    wide = joined.withColumns(
        {
            "client_tenure": tenure,
            "ins_typ_count": F.coalesce("ins_typ_count", F.lit(0)),
            "multi_prod": bands.flag("pol_count >= 2"),
            "inforce_ind": bands.flag("inforce_pol > 0"),
            "f_with_rider": bands.flag("rider_cnt > 0"),
            "f_male": bands.flag("sex_code = 'M'"),
            **{f"f_{n}_pol": bands.flag(f"{n}_pol > 0") for n in products},
            **{f"f_{o}_{n}": bands.flag(f"{col} = {v!r}") for o, col in ordinal.items() for n, v in products.items()},
            "vip": F.coalesce(vip_label(c("coverage_ape"), c("long_pol_cnt")), F.lit("none")),
            "top1_3_lapse": bands.flag("lapse_decile < 4"),
            "move_reg": bands.flag("activation_date is not null"),
            "move_tenure_days": F.datediff(cut, "activation_date"),
            "move_last_log_days": F.datediff(cut, "lst_login_dt"),
            "cws_reg": bands.flag("cws_joint_dt is not null"),
            "cws_tenure_days": F.datediff(cut, "cws_joint_dt"),
            "cws_last_log_days": F.datediff(cut, "cws_lst_login_dt"),
            **{name: bands.flag(c("city") == city) for name, city in cities.items()},
            "f_oth_city": bands.flag(~c("city").isin(list(cities.values()))),
            **{name: bands.flag(c("customer_segment") == segment) for name, segment in segments.items()},
            "incm_2": F.coalesce(c("max_income") / rate, c("mthly_incm")),
            "adj_mthly_incm": adjusted_income(c("mthly_incm"), tenure),
            "cli_nbv_margin": money.safe_ratio(c("plan_nbv"), c("coverage_ape")),
        }
    )
    return wide.withColumns({f"f_vip_{n}": bands.flag(f"vip = '{n}'") for n in VIP_BOUNDS}).drop(
        "ins_typ_desc_1", "ins_typ_desc_2", "activation_date", "reg_dt", "lst_login_dt", "long_pol_cnt", "cws_joint_dt", "cws_lst_login_dt", "max_income"
    )


# ---------------------------------------------------------------- claims per owner

# Claim type codes that count.
CLAIM_CODES = [3, 7, 9, 11, 27, 28, 29, 36, 38, 50, 51]


def owner_claims(t: Frames, snapshot: str, rate: Column) -> DataFrame:
    """Approved claims of 6 and 12 months per policy, then per owner; last date and its amount."""
    snap = day(snapshot)
    rows = t["claim"].filter(
        (c("clm_aprov_dt") <= snap) & (c("clm_stat_code") == "A") & c("clm_code").isin(CLAIM_CODES)
    )
    within = {m: c("clm_aprov_dt") >= F.add_months(snap, -m) for m in (6, 12)}
    amount = money.exact(c("clm_aprov_amt"), 4)
    per_policy = rows.groupBy("pol_num").agg(
        *[F.count(F.when(w, c("clm_id"))).alias(f"n_{m}") for m, w in within.items()],
        *[F.sum(F.when(w, amount)).alias(f"amt_{m}") for m, w in within.items()],
        F.max(F.struct("clm_aprov_dt", amount.alias("amt"))).alias("last"),
    )
    owned = t["policy"].filter(k.sold()).select("pol_num", "po_num")
    per_owner = owned.join(per_policy, "pol_num").groupBy("po_num").agg(
        *[F.sum(f"n_{m}").alias(f"clm_{m}m_cnt") for m in within],
        *[F.coalesce(F.sum(f"amt_{m}").cast("double"), F.lit(0.0)).alias(f"clm_{m}m_amt") for m in within],
        F.max("last").alias("last"),
    )
    return per_owner.select(
        "po_num", "clm_6m_cnt", "clm_12m_cnt",
        (c("clm_6m_amt") / rate).alias("clm_6m_amt"),
        (c("clm_12m_amt") / rate).alias("clm_12m_amt"),
        c("last.clm_aprov_dt").alias("clm_lst_dt"),
        c("last.amt").cast("double").alias("clm_lst_amt"),
    )
