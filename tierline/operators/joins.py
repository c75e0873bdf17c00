"""Joins. Which side is broadcast is left to Spark, which knows sizes in bytes, but for sides that it knows by a far
too low estimate: these are merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions.dates import month_index

def join_inner(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on))


def join_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left")


def join_composite(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def join_named_keys(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left") -> DataFrame:
    """Equi-join where the key columns are named differently on the two sides."""
    conds = [left[a] == right[b] for a, b in keys.items()]
    return left.join(right, conds, how)


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One fact left-joined to several dimensions; each dimension has one row per key."""
    out = fact
    for dim, on in dims:
        out = out.join(dim, list(on), "left")
    return out


def join_broadcast(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a side that is small as a rule. Spark broadcasts it while its bytes are below
    `spark.sql.autoBroadcastJoinThreshold`, by estimate or as found while running, and shuffles it beyond."""
    return left.join(right, list(on), how)


def join_merged(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a side that grows with the data.

    Spark estimates a side it reads by the size of the files, where a million rows of repeated values take a
    few megabytes, and would send it to every task through the driver. It is merged, whatever the estimate.
    """
    return left.join(right.hint("merge"), list(on), how)


def join_roles(fact: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str], cols: Sequence[str]) -> DataFrame:
    """Join the same dimension once per role: fact column -> prefix of the joined columns."""
    out = fact
    for col, prefix in roles.items():
        side = dim.select(F.col(key).alias(col), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
        out = out.join(side, col, "left")
    return out


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    l_dt: str,
    r_dt: str,
    low: int,
    high: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs of equal key where floor(months between l_dt and r_dt) is in low..high.

    A hot key with a long history would test all its pairs. So months are cut into buckets a few
    times as wide as the interval and the bucket joins the equi key. A right row reaches
    high - low + 2 calendar months, which lie in one bucket or in two: it is repeated at most once,
    and since a left row has one bucket, no pair comes twice.

    The repeated side is merged: Spark does not know how far an array unfolds, neither here nor where
    `right` comes from, and would broadcast it by the size of its files.
    """
    width = 3 * (high - low + 2)
    reached = month_index(F.col(r_dt))
    buckets = F.array_distinct(
        F.array(F.floor((reached + low) / F.lit(width)), F.floor((reached + (high + 1)) / F.lit(width)))
    )
    reach = right.withColumnsRenamed({k: f"_r_{k}" for k in key}).withColumn("_bucket", F.explode(buckets))
    cond = F.floor(month_index(F.col(l_dt)) / F.lit(width)) == F.col("_bucket")
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    apart = F.floor(F.months_between(F.col(l_dt), F.col(r_dt)))
    return left.join(reach.hint("merge"), cond & apart.between(low, high), how).drop(
        "_bucket", *[f"_r_{k}" for k in key]
    )


def lookup_coalesce(first: Column, second: Column, default: Column | None = None) -> Column:
    """Value of two sources already joined: the first that is known."""
    return F.coalesce(first, second, *([default] if default is not None else []))


def join_semi(left: DataFrame, right: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows of `left` whose key occurs in `right`."""
    return left.join(right, [left[a] == right[b] for a, b in keys.items()], "left_semi")


def flag_exists(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """1 where the key occurs in `other`, else 0."""
    seen = other.select(F.col(key).alias("_seen")).distinct()
    out = df.join(seen, F.col(key) == F.col("_seen"), "left")
    return out.withColumn(name, F.col("_seen").isNotNull().cast("int")).drop("_seen")


# Relation codes of insured persons by kind of dependent.
DEPENDENT_CODES = {
    "dpnd_grandpa_ind": ["05"],
    "dpnd_parent_ind": ["51", "52"],
    "dpnd_spouse_ind": ["02"],
    "dpnd_child_ind": ["03"],
    "dpnd_sibling_ind": ["04"],
    "dpnd_oth_ind": ["10", "31"],
}


def dependent_flags(insured: DataFrame, owner: str, code: str) -> DataFrame:
    """One 0/1 column per kind of dependent and an overall one; owners without any are left out."""
    known = [c for codes in DEPENDENT_CODES.values() for c in codes]
    flags = insured.filter(F.col(code).isin(known)).groupBy(owner).agg(
        *[F.max(F.col(code).isin(codes).cast("int")).alias(n) for n, codes in DEPENDENT_CODES.items()]
    )
    return flags.withColumn("f_dependent_ind", F.greatest(*[F.col(n) for n in DEPENDENT_CODES]))


def merge_metrics(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer merge of per-key measures, missing ones 0. The frames share only the key."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, key, "full")
    return out.na.fill(0, [c for c in out.columns if c != key])


def join_kpi_chain(first: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Further per-key measures joined onto the first frame's keys, missing ones 0."""
    out = star_join(first, [(o, [key]) for o in others])
    return out.na.fill(0, [c for c in out.columns if c != key])


def map_by_key(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Attach one value per key; where a key has several, the lowest."""
    one = lookup.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left")


def identity_match(policies: DataFrame, owners: DataFrame, agents: DataFrame) -> DataFrame:
    """1 for owners who are the same person as the writing agent of one of their policies.

    Same person: equal id number, or equal name, birth date, sex and one of e-mail and phone. The
    join is by agent code; the alternatives are a condition on the joined row.
    """
    person = ["id_num", "per_nm", "birth_dt", "sex_code", "email_addr", "mobl_phon_num"]
    own = owners.select(F.col("cli_num").alias("po_num"), *[F.col(c).alias(f"o_{c}") for c in person])
    agt = agents.select(F.col("agt_code").alias("wa_code"), *[F.col(c).alias(f"a_{c}") for c in person])
    pairs = policies.select("po_num", "wa_code").distinct()
    same = {c: F.col(f"o_{c}") == F.col(f"a_{c}") for c in person}
    who = same["per_nm"] & same["birth_dt"] & same["sex_code"]
    match = same["id_num"] | (who & same["email_addr"]) | (who & same["mobl_phon_num"])
    return (
        join_merged(pairs, own, ["po_num"], "inner")
        .join(agt, "wa_code", "left")
        .groupBy("po_num")
        .agg(F.max(F.when(match, 1).otherwise(0)).alias("f_owner_is_agent"))
    )
