"""Cluster queries and the SQL they must equal: k-means in whole units, round by round."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.catalog.base import average, derived, query
from tierline.catalog.customer_checks import client_level
from tierline.plans import cluster as C
from tierline.sources.sink import fresh_path, stage_last

# Stated anew, in the order of the features.
_SCALED = """cli_ltv cli_ltv_pre cli_ltv_post client_tenure pol_count ins_typ_count inforce_pol lapse_pol surr_pol mature_pol nottaken_pol ter_pol
    paid_pol mthly_incm coverage_ape plan_nbv cli_nbv_margin no_dpnd move_tenure_days move_last_log_days cws_tenure_days cws_last_log_days""".split()
_NONE_IS_99 = "agt_tenure_yrs min_decile early_lapse_decile next_due_lapse_decile yr_2nd_prod".split()
_NONE_IS_0 = """term_pol endow_pol health_indem_pol whole_pol investment_pol f_same_agent f_cash f_cheque f_auto mdrt_flag mdrt_tot_flag mdrt_cot_flag
    active_1m_flag multi_prod annual_flag valid_email valid_mobile cur_age f_HCM f_HN f_DN f_oth_city f_adult_self_insured f_family f_family_wkids
    f_empty_nest f_undefined_segment f_male f_vip_elite f_vip_plat f_vip_gold f_vip_silver f_1st_term f_1st_endow f_1st_health_indem f_1st_whole
    f_1st_investment f_2nd_term f_2nd_endow f_2nd_health_indem f_2nd_whole f_2nd_investment""".split()
_NAMES = [*_SCALED, *_NONE_IS_99, *_NONE_IS_0]
_K, _ROUNDS = 5, 10

derived(
    "sample",
    "select * from client_level where ('0x' || substr(md5('123:' || po_num::varchar), 1, 5))::int < (0.3 * 1048576)::int",
)
derived("sample_means", "select " + ", ".join(f"coalesce({average(n + '::double', 6)}, 0.0e0) as {n}" for n in _SCALED) + " from sample")


def _square(n: str) -> str:
    return f"(s.{n}::double - m.{n}) * (s.{n}::double - m.{n})"


derived(
    "sample_scales",
    "select "
    + ", ".join(
        f"coalesce(nullif(sqrt(coalesce(sum(cast(cast({_square(n)} as varchar) as decimal(38,6)))::double, 0.0e0) / count(*)), 0), 1.0e0) as {n}" for n in _SCALED
    )
    + " from sample s join sample_means m on true",
)


def _units(value: str) -> str:
    return f"floor({value} * 1000000.0e0 + 0.5e0)::bigint"


def _features(table: str) -> str:
    parts = [_units(f"((coalesce(s.{n}::double, m.{n}) - m.{n}) / d.{n} * {'10.0e0' if n == 'cli_ltv' else '1.0e0'})") for n in _SCALED]
    parts += [_units(f"coalesce(s.{n}::double, 99.0e0)") for n in _NONE_IS_99] + [_units(f"coalesce(s.{n}::double, 0.0e0)") for n in _NONE_IS_0]
    return f"select po_num, [{', '.join(parts)}] as x from {table} s join sample_means m on true join sample_scales d on true"


derived("sample_points", _features("sample"))
derived("every_point", _features("client_level"))
# The distance of a point to each centre; the first of the nearest is its cluster.
_DISTANCES = (
    "list_transform(centres, lambda z: list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - z[i])::double * (x[i] - z[i])::double)))"
)


def _rounds(label: str, ks: str) -> str:
    """Registers the rounds as `<label>_0` to `<label>_10`; returns the last."""
    derived(
        f"{label}_0",
        f"""select k, list(x order by place) as centres from (select *, row_number() over (order by x[1], po_num) - 1 as place, count(*) over () as n from sample_points) p,
            (select unnest({ks}) as k) ks, range(k) picks(j) where place = (2 * j + 1) * n // (2 * k) group by k""",
    )
    for r in range(1, _ROUNDS + 1):
        before = f"{label}_{r - 1}"
        derived(
            f"{label}_{r}",
            f"""select k, list(centre order by j) as centres from (
                  select a.k, a.j, coalesce(any_value(b.centre), any_value(a.old)) as centre
                  from (select k, unnest(range(k)) + 1 as j, unnest(centres) as old from {before}) a
                  left join (select k, j, list(v order by d) as centre from (
                      select k, j, d, floor((2 * sum(v) + count(*))::double / (2 * count(*)))::bigint as v from (
                        select k, list_position(ds, list_min(ds)) as j, unnest(range(1, len(x) + 1)) as d, unnest(x) as v
                        from (select k, x, {_DISTANCES} as ds from sample_points join {before} on true) q) u group by k, j, d) g group by k, j) b
                    on b.k = a.k and b.j = a.j group by a.k, a.j) c group by k""",
        )
    return f"{label}_{_ROUNDS}"


_FIVE, _ALL = _rounds("five", f"[{_K}]"), _rounds("upto9", "range(1, 10)")
derived("scored", f"select po_num, (list_position(ds, list_min(ds)) - 1)::int as clusters from (select po_num, {_DISTANCES} as ds from every_point join {_FIVE} on true) q")


def level(t):
    return stage_last(client_level(t), "client_level", ["owners"])


def clusters(people):
    return C.customer_clusters(people, C.fit_centres(people))


@query(
    "cluster_elbow",
    f"select k::int as k, floor(sum(list_min(ds)) / 1e12 * 100 + 0.5e0) / 100 as inertia from (select k, {_DISTANCES} as ds from sample_points join {_ALL} on true) q group by k",
)
def _(t):
    return C.cluster_elbow(level(t))


@query(
    "cluster_centres",
    f"""select {_K} as k, (j - 1)::int as cluster, feature, v / 1000000.0e0 as centre from (
          select j, unnest({_NAMES!r}) as feature, unnest(centre) as v from (select unnest(range(1, {_K + 1})) as j, unnest(centres) as centre from {_FIVE}) c) q""",
)
def _(t):
    return C.centre_table(t.spark, C.fit_centres(level(t)))


@query("customer_clusters", "select * from scored")
def _(t):
    return clusters(level(t))


@query(
    "cluster_profiles",
    "select clusters, count(po_num) as customer_count, "
    + ", ".join(
        f"{average(n, 4)} as mean_{n}"
        for n in "cli_ltv cli_ltv_pre cli_ltv_post pol_count client_tenure cur_age mthly_incm coverage_ape inforce_pol".split()
    )
    + " from client_level join scored using (po_num) group by clusters",
)
def _(t):
    people = level(t)
    return C.cluster_profiles(people, clusters(people))


@query("save_load_model", "select count(*) as customers, 0 as moved from client_level")
def _(t):
    """Customers, and how many of them a model that was saved and loaded puts elsewhere."""
    people = level(t)
    path = fresh_path(t.spark, "model")
    prep, model = C.fit_clusters(people)
    C.save_model(prep, model, path)
    before = C.predicted_clusters(people, prep, model).withColumnRenamed("clusters", "before")
    both = before.join(C.predicted_clusters(people, *C.load_model(t.spark, path)), "po_num", "full")
    moved = F.coalesce(F.sum((~F.col("before").eqNullSafe(F.col("clusters"))).cast("int")), F.lit(0))
    return both.agg(F.count("*").alias("customers"), moved.alias("moved"))


@query("score_all_segments", "select customer_segment, clusters, count(*) as customers from client_level join scored using (po_num) group by 1, 2")
def _(t):
    people = level(t)
    return C.segment_clusters(people, clusters(people))
