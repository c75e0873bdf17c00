"""In-force customers by income: deciles, protection gap, segments, profiles, targets.

All functions but `income_frame` take its result, written once, and read only the columns they use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions import bands, dates, money
from tierline.operators import aggregates as agg
from tierline.operators import joins, ordered, ranking
from tierline.plans.common import Frames, day
from tierline.plans.customers import INCOME_CAP
from tierline.sources.sink import stage

c = F.col

# Lower income bounds (monthly, converted) of the income classes.
INCOME_CLASS_BOUNDS = [
    (1717, "A > 1717"),
    (1288, "B > 1288-1717"),
    (858, "C > 858-1288"),
    (644, "D > 644-858"),
    (429, "E > 429-644"),
]
VIP_CLASS_BOUNDS = [
    (10000, "A. > 10K"),
    (7000, "B. 7-10K"),
    (5000, "C. 5-7K"),
    (3000, "D. 3-5K"),
    (2000, "E. 2-3K"),
    (1500, "F. 1.5-2K"),
]
SEGMENT_OF_CLASS = {
    "A. > 10K": "1 VIP",
    "B. 7-10K": "1 VIP",
    "C. 5-7K": "1 VIP",
    "D. 3-5K": "2 High Income",
    "E. 2-3K": "3 Mid Income",
    "F. 1.5-2K": "3 Mid Income",
    "G. 500-1.5K": "4 Low Income",
    "H. <500": "5 Bottom of Pyramid",
}
LOWEST_INCOME = 43.0
GAP_MONTHS, WALLET_MONTHS, WALLET_SHARE = 120, 12, 0.10


def income_class(income: Column) -> Column:
    rules = [(income >= low, label) for low, label in INCOME_CLASS_BOUNDS]
    return bands.first_match([*rules, (income < 429, "F <429")], "G Null")


def vip_income_class(income: Column) -> Column:
    rules = [(income > low, label) for low, label in VIP_CLASS_BOUNDS]
    return bands.first_match([*rules, (income >= 500, "G. 500-1.5K"), (income < 500, "H. <500")], "I. NaN")


def income_deciles(level: DataFrame) -> DataFrame:
    """In-force customers with exact income and value deciles and the capped income."""
    live = level.filter(c("inforce_ind") == 1)
    orders = {
        "income_decile": [("adj_mthly_incm", "desc"), ("po_num", "asc")],
        "ltv_decile": [("cli_ltv_mod", "desc"), ("po_num", "asc")],
    }
    adj = c("adj_mthly_incm")
    capped = F.when(adj < LOWEST_INCOME, F.lit(LOWEST_INCOME)).when(c("mthly_incm") >= INCOME_CAP, F.lit(INCOME_CAP)).otherwise(adj)
    return ordered.ntile_multi(live, 10, orders).withColumn("mthly_incm_capped", capped)


def protection_gap(frame: DataFrame) -> DataFrame:
    """Income protection missing for dependents, and the share of income not yet spent on premium."""
    earning = c("adj_mthly_incm") > 0
    income = F.least(c("adj_mthly_incm"), F.lit(INCOME_CAP))
    dependent = F.when(c("f_dependent_ind").isNotNull(), 1)

    def gap(face: str) -> Column:
        return F.when(earning, dependent * (income * GAP_MONTHS - F.coalesce(c(face), F.lit(0.0))))

    return frame.withColumns(
        {
            "f_with_dependent": dependent,
            "mthly_incm_99": F.when(earning, income),
            "protection_gap_v2": gap("protection_fa"),
            "protection_gap_all": gap("tot_face_amt_usd"),
            "wallet_rem": F.when(earning, income * WALLET_MONTHS - c("coverage_ape")),
        }
    )


def income_frame(level: DataFrame) -> DataFrame:
    """`level` is the client-level frame read back from where it was written."""
    frame = protection_gap(income_deciles(level))
    return frame.withColumns(
        {
            "local_income_class": income_class(c("mthly_incm_99")),
            "vip_income_class": vip_income_class(c("adj_mthly_incm")),
        }
    ).withColumn("income_segment", bands.map_codes(c("vip_income_class"), SEGMENT_OF_CLASS, "6 No/Missing Income"))


def income_class_pyramid(frame: DataFrame) -> DataFrame:
    return agg.crosstab_counts(frame, ["income_decile", "local_income_class"])


def income_segments(frame: DataFrame) -> DataFrame:
    """Customers, means and wallet share per income segment."""
    ape, income = money.mean(c("coverage_ape"), 4), money.mean(c("adj_mthly_incm"), 4)
    return frame.groupBy("income_segment").agg(
        F.count("po_num").alias("customers"),
        money.mean(c("unassigned_ind")).alias("share_unassigned"),
        income.alias("mean_income"),
        money.mean(c("cli_ltv_mod"), 4).alias("mean_cltv"),
        money.mean(c("protection_fa_all"), 4).alias("mean_protection_fa_all"),
        money.mean(c("protection_gap_all"), 4).alias("mean_protection_gap_all"),
        ape.alias("mean_ape"),
        F.try_divide(ape, income * (WALLET_MONTHS * WALLET_SHARE)).alias("wallet_share"),
    )


_MEANS = [
    "adj_mthly_incm", "cli_ltv", "cli_ltv_pre", "cli_ltv_post", "cli_ltv_mod", "cli_ltv_pre_mod", "cli_ltv_post_mod",
    "pol_count", "client_tenure", "f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver", "cur_age", "no_dpnd", "f_male",
    "inforce_pol", "lapse_pol", "surr_pol", "mature_pol", "nottaken_pol", "ter_pol", "paid_pol", "ins_typ_count",
    "f_term_pol", "f_endow_pol", "f_health_indem_pol", "f_whole_pol", "f_investment_pol",
    "f_1st_term", "f_1st_endow", "f_1st_health_indem", "f_1st_whole", "f_1st_investment",
    "f_2nd_term", "f_2nd_endow", "f_2nd_health_indem", "f_2nd_whole", "f_2nd_investment",
    "yr_2nd_prod", "tot_ape_1", "agt_tenure_yrs", "mdrt_flag", "mdrt_tot_flag", "mdrt_cot_flag", "multi_prod",
    "f_same_agent", "annual_flag", "valid_email", "valid_mobile", "f_cash", "f_cheque", "f_auto",
    "coverage_ape", "inforce_ind", "top1_3_lapse", "early_lapse_decile", "move_reg", "move_last_log_days", "move_tenure_days",
    "unassigned_ind", "f_trmn_0_6m", "f_trmn_6_12m", "f_trmn_12_18m", "f_purchase_0_6m", "f_purchase_6_12m", "f_purchase_12_18m",
    "f_mat_0_12m", "f_mat_12_24m", "active_1m_flag", "f_HCM", "f_HN", "f_DN", "f_oth_city", "f_adult_self_insured", "f_family",
    "f_family_wkids", "f_empty_nest", "f_undefined_segment", "cws_reg", "cws_tenure_days", "cws_last_log_days", "incm_2",
    "min_decile", "next_due_lapse_decile", "lapse_decile", "plan_nbv", "rider_ape", "rider_cnt", "f_with_rider", "protection_fa", "protection_fa_all",
]

# The measures of every customer profile: name, function, column, condition, decimals.
PROFILE: list[agg.Measure] = [
    ("customer_count", "count", "po_num", None, 0),
    *[(f"mean_{n}", "mean", n, None, 4) for n in _MEANS],
    ("sum_with_dependent", "sum", "f_with_dependent", None, 0),
    ("sum_transaction_usd", "sum", "transaction_usd", None, 4),
    ("sum_owner_is_agent", "sum", "f_owner_is_agent", None, 0),
    ("lead_count", "sum", "lead_cnt", None, 0),
    ("conversion", "sum", "conversion", None, 0),
    ("conversion_ape", "sum", "conversion_ape", None, 4),
    ("conversion_nbv", "sum", "conversion_nbv", None, 4),
    # One row per customer, so counting the rows counts distinct customers.
    ("count_female", "count", "po_num", "sex_code = 'F'", 0),
    ("mean_inf_ltv", "mean", "cli_ltv_mod", "inforce_ind > 0", 4),
]


def segment_profiles(frame: DataFrame, by: Sequence[str] = ("income_segment",)) -> DataFrame:
    return agg.profile(frame, by, PROFILE)


def vip_only(frame: DataFrame) -> DataFrame:
    """The top income segment with its own income deciles."""
    order = [("adj_mthly_incm", "desc"), ("po_num", "asc")]
    return ordered.ntile_within(frame, c("income_segment") == "1 VIP", 10, order, "vip_decile")


def top_n_profiles(frame: DataFrame, sizes: Sequence[int] = (100, 250, 500)) -> DataFrame:
    """The profile of the best-earning customers of the top segment, for several list lengths.

    The longest list is cut once; it is as long as the largest size at most.
    """
    order = [("adj_mthly_incm", "desc"), ("po_num", "asc")]
    vip = frame.filter(c("income_segment") == "1 VIP")
    place = F.row_number().over(Window.orderBy(c("adj_mthly_incm").desc(), "po_num"))
    longest = stage(ranking.top_n(vip, order, max(sizes)).withColumn("_place", place), "top_n")
    parts = [
        agg.profile_total(longest.filter(c("_place") <= n), PROFILE).select(F.lit(n).alias("top_n"), "*") for n in sizes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


PROTECTION: list[agg.Measure] = [
    ("customer_count", "count", "po_num", None, 0),
    ("mean_protection_gap_v2", "mean", "protection_gap_v2", None, 4),
    ("mean_protection_gap_all", "mean", "protection_gap_all", None, 4),
    ("mean_protection_fa", "mean", "protection_fa", None, 4),
    ("mean_protection_fa_all", "mean", "protection_fa_all", None, 4),
    ("mean_wallet_rem", "mean", "wallet_rem", None, 4),
]


def protection_summary(frame: DataFrame, by: str = "income_segment") -> DataFrame:
    """Protection measures of customers with dependents."""
    return agg.profile(frame.filter(c("f_with_dependent") == 1), [by], PROTECTION)


def protection_of_unassigned(frame: DataFrame) -> DataFrame:
    """Protection measures of in-force customers without an agent, per value decile."""
    return agg.profile(frame.filter((c("inforce_ind") == 1) & (c("unassigned_ind") == 1)), ["ltv_decile"], PROTECTION)


def use_cases() -> dict[int, Column]:
    """Target rules of the three campaigns: unassigned in-force customers of the best deciles."""
    base = (c("inforce_ind") == 1) & (c("unassigned_ind") == 1) & (c("ltv_decile") < 4) & (c("mthly_incm") > 500)
    dependent = c("f_with_dependent") == 1
    return {
        1: base & (c("multi_prod") == 0) & (c("f_1st_investment") == 1) & (c("min_prem_dur") > 5) & (c("client_tenure") > 0.58333),
        2: base & (c("f_mat_0_12m") == 1) & (c("multi_prod") == 0) & dependent,
        3: base & (c("protection_gap_v2") > 50000) & (c("client_tenure") > 1) & dependent & (c("f_term_pol") == 0) & (c("f_whole_pol") == 0),
    }


def use_case_targets(frame: DataFrame) -> DataFrame:
    """Customers of each use case, in one pass over the frame."""
    hits = F.array(*[F.when(cond, n) for n, cond in use_cases().items()])
    return frame.select("po_num", F.explode(F.array_compact(hits)).alias("use_case"))


def use_case_counts(frame: DataFrame) -> DataFrame:
    """Size of the step-by-step narrowing to unassigned, top-decile customers by segment."""
    wanted = (c("unassigned_ind") == 1) & (c("ltv_decile") < 4)
    return agg.profile(frame.filter(wanted), ["income_segment"], [("customers", "count", "po_num", None, 0)])


def lead_conversion(frame: DataFrame) -> DataFrame:
    """Customers with leads, those that bought after one, and the sales that followed a lead with their value, per
    income segment. A sale before the customer's first lead is no conversion (`customers.owner_leads`)."""
    spec: list[agg.Measure] = [
        ("lead_count", "count", "lead_cnt", None, 0),
        ("converted_leads", "count", "lead_cnt", "conversion > 0", 0),
        ("conversion", "sum", "conversion", None, 0),
        ("conversion_ape", "sum", "conversion_ape", None, 4),
        ("conversion_nbv", "sum", "conversion_nbv", None, 4),
    ]
    return agg.profile(frame, ["income_segment"], spec)
