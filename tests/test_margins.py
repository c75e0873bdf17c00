"""The margin rules of coverages: one distinct margin per role, precedence, fallbacks."""


from tierline.plans import common
from tierline.plans import customers as K

ROLES = ["agency_affinity", "agency", "dmtm", "other_channel_affinity", "other_channel", "banca_other_banks", "banca_scb", "banca_tcb"]
CASES = [
    # (location, channel) -> role, stated anew from the rule, not from the code
    (None, "03", "banca_other_banks"), (None, "53", "banca_other_banks"), (None, "48", "other_channel_affinity"),
    (None, "01", "agency"), (None, "50", "agency"), (None, "*", "agency"), (None, "05", "dmtm"), (None, "36", "dmtm"),
    (None, "09", None), (None, "77", "other_channel"), (None, None, "other_channel"),
    ("TCB01", "03", "banca_tcb"), ("TCB01", "*", "agency"), ("SAG9", "01", "banca_scb"), ("SAG9", "09", "banca_scb"),
    ("XX", "05", "other_channel"), ("", "03", "other_channel"), ("tcb", "48", "other_channel"), ("XX", "*", "agency"), ("XX", None, "other_channel"),
]


def frames(spark, missing=()):
    static = [None if r in missing else float(10 + i) for i, r in enumerate(ROLES)]
    dated = [float(20 + i) for i in range(len(ROLES))]
    columns = ", ".join(f"nbv_margin_{r} double" for r in ROLES)
    plan = spark.createDataFrame([(1, *static), (2, *[None] * len(ROLES))], f"plan_code int, {columns}")
    quarters = spark.createDataFrame([(1, "2001 Q1", *dated), (3, "2001 Q1", *dated)], f"plan_code int, effective_qtr string, {columns}")
    return plan, quarters


def margins(spark, rows, rules=None, missing=()):
    df = spark.createDataFrame(rows, "plan_code int, effective_qtr string, loc_cd string, dist_chnl_cd string, id int")
    out = K.with_margin(df, *frames(spark, missing), rules or K.margin_rules())
    assert set(out.columns) == {*df.columns, "nbv_margin"}
    return {r["id"]: r["nbv_margin"] for r in out.collect()}


def wanted(role, base):
    return -1.34041044648343 if role is None else float(base + ROLES.index(role))


def test_each_case_earns_its_role(spark):
    rows = [(1, "2001 Q1", loc, channel, i) for i, (loc, channel, _) in enumerate(CASES)]
    assert margins(spark, rows) == {i: wanted(role, 10) for i, (_, _, role) in enumerate(CASES)}


def test_margin_of_the_quarter_where_the_plan_has_none(spark):
    rows = [(p, q, loc, channel, i * 10 + p) for i, (loc, channel, _) in enumerate(CASES) for p, q in ((2, "2001 Q1"), (3, "2001 Q1"), (4, None))]
    got = margins(spark, rows)
    for i, (_, _, role) in enumerate(CASES):
        assert got[i * 10 + 3] == wanted(role, 20)
        assert got[i * 10 + 2] == got[i * 10 + 4] == (None if role else wanted(role, 0))
    some = margins(spark, [(1, "2001 Q1", "TCB", "01", 0), (1, "2001 Q2", "TCB", "01", 1), (1, "2001 Q1", "SAG", "01", 2)], missing=["banca_tcb"])
    assert some == {0: wanted("banca_tcb", 20), 1: None, 2: wanted("banca_scb", 10)}


def test_a_swapped_role_shows(spark):
    rows = [(1, "2001 Q1", loc, channel, i) for i, (loc, channel, _) in enumerate(CASES)]
    right = margins(spark, rows)
    rules = K.margin_rules()
    for at, rule in enumerate(rules):
        swapped = [*rules[:at], rule._replace(role="agency_affinity", fixed=None), *rules[at + 1 :]]
        assert margins(spark, rows, swapped) != right


def test_other_banks_are_a_parameter(spark):
    rows = [(1, "2001 Q1", "ABC1", "01", 0), (1, "2001 Q1", "TCB1", "01", 1)]
    assert margins(spark, rows, K.margin_rules({"ABC": "banca_scb"})) == {0: wanted("banca_scb", 10), 1: wanted("other_channel", 10)}


def test_status_families():
    assert K.STATUS_FLAGS["f_inforce_ind"] == ["1", "2", "3", "5"] and K.STATUS_FLAGS["f_paid_ind"] == ["4", "7", "9"]
    assert K.LATER_STATUS_FLAGS["f_inforce_ind"] == ["1", "3"] and K.LATER_STATUS_FLAGS["f_paid_ind"] == ["2", "4", "5", "7", "9"]
    assert {n: v for n, v in K.LATER_STATUS_FLAGS.items() if n not in ("f_inforce_ind", "f_paid_ind")} == {
        "f_lapse_ind": common.LAPSED, "f_surr_ind": common.SURRENDERED, "f_mature_ind": common.MATURED,
        "f_nottaken_ind": common.NOT_TAKEN, "f_ter_ind": common.TERMINATED,
    }
