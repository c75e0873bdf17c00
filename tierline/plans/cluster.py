"""Customer clusters: impute, scale, weight, choose the number, fit on a sample, score everyone."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import money
from tierline.operators import aggregates as agg
from tierline.operators import joins, ordered
from tierline.sources.sink import stage

c = F.col

# Columns whose gaps mean "none": filled with a value outside the range. They enter unscaled.
SPARSE = ["agt_tenure_yrs", "min_decile", "early_lapse_decile", "next_due_lapse_decile", "yr_2nd_prod"]
SPARSE_FILL = 99.0
# Codes, counts and flags: gaps become 0, unscaled.
CODES = [
    "term_pol", "endow_pol", "health_indem_pol", "whole_pol", "investment_pol", "f_same_agent", "f_cash", "f_cheque", "f_auto",
    "mdrt_flag", "mdrt_tot_flag", "mdrt_cot_flag", "active_1m_flag", "multi_prod", "annual_flag", "valid_email", "valid_mobile", "cur_age",
    "f_HCM", "f_HN", "f_DN", "f_oth_city", "f_adult_self_insured", "f_family", "f_family_wkids", "f_empty_nest", "f_undefined_segment",
    "f_male", "f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver",
    "f_1st_term", "f_1st_endow", "f_1st_health_indem", "f_1st_whole", "f_1st_investment",
    "f_2nd_term", "f_2nd_endow", "f_2nd_health_indem", "f_2nd_whole", "f_2nd_investment",
]
# Measures: gaps become the mean, then standardised.
MEASURES = [
    "cli_ltv", "cli_ltv_pre", "cli_ltv_post", "client_tenure", "pol_count", "ins_typ_count", "inforce_pol",
    "lapse_pol", "surr_pol", "mature_pol", "nottaken_pol", "ter_pol", "paid_pol", "mthly_incm", "coverage_ape", "plan_nbv",
    "cli_nbv_margin", "no_dpnd", "move_tenure_days", "move_last_log_days", "cws_tenure_days", "cws_last_log_days",
]
FEATURES = [*MEASURES, *SPARSE, *CODES]
WEIGHTS = {"cli_ltv": 10.0}


def sample_rows(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A share of the rows chosen by a hash of the key (its first five hexadecimal digits): the same rows
    on any partitioning, and in any engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c(key).cast("string"))), 1, 5)
    return df.filter(F.conv(digits, 16, 10).cast("int") < int(share * (1 << 20)))


def cluster_inputs(level: DataFrame, key: str = "po_num") -> DataFrame:
    sparse = [F.coalesce(c(n).cast("double"), F.lit(SPARSE_FILL)).alias(n) for n in SPARSE]
    codes = [F.coalesce(c(n).cast("double"), F.lit(0.0)).alias(n) for n in CODES]
    return level.select(key, *sparse, *codes, *[c(n).cast("double").alias(n) for n in MEASURES])


def preparation(measures: Sequence[str] = MEASURES) -> Pipeline:
    """Imputation, scaling and weighting. The same weights apply when fitting and when scoring."""
    weights = Vectors.dense([WEIGHTS.get(n, 1.0) for n in measures])
    return Pipeline(
        stages=[
            Imputer(strategy="mean", inputCols=list(measures), outputCols=[f"{n}_i" for n in measures]),
            VectorAssembler(inputCols=[f"{n}_i" for n in measures], outputCol="measures"),
            StandardScaler(withMean=True, withStd=True, inputCol="measures", outputCol="scaled"),
            ElementwiseProduct(scalingVec=weights, inputCol="scaled", outputCol="weighted"),
            VectorAssembler(inputCols=["weighted", *SPARSE, *CODES], outputCol="features"),
        ]
    )


def prepare_sample(level: DataFrame, share: float, seed: int) -> tuple[PipelineModel, DataFrame]:
    """Fitted preparation, and the prepared sample written out: every pass of the fit reads it."""
    sample = stage(cluster_inputs(sample_rows(level, "po_num", share, seed)), "sample")
    model = preparation().fit(sample)
    return model, stage(model.transform(sample).select("po_num", "features"), "prepared")


# The clusters themselves: a model of two small tables, fitted by exact sums, so that any engine finds the same.

#: Features are whole multiples of 1 / UNIT: their sums do not depend on the order of the rows.
UNIT = 1_000_000
ROUNDS = 10


class ClusterModel(NamedTuple):
    """Mean and scale of each measure, and for each number of clusters the centres, all in FEATURES order.
    Everything is of a fixed size, whatever the number of customers."""

    means: list[float]
    scales: list[float]
    centres: dict[int, list[list[int]]]


def measure_scales(sample: DataFrame) -> tuple[list[float], list[float]]:
    """Mean of each measure where known, and the deviation of all rows around it, gaps at the mean. A measure
    without spread has scale 1, one that is never known has mean 0."""
    known = [F.coalesce(money.mean(c(n), 6), F.lit(0.0)).alias(n) for n in MEASURES]
    means = list(sample.agg(*known).first())
    square = [F.sum(money.exact((c(n) - F.lit(m)) * (c(n) - F.lit(m)), 6)).cast("double").alias(n) for n, m in zip(MEASURES, means)]
    row = sample.agg(F.count("*").alias("_rows"), *square).first()
    spreads = [(row[n] or 0.0) / row["_rows"] if row["_rows"] else 0.0 for n in MEASURES]
    return means, [math.sqrt(v) or 1.0 for v in spreads]


def cluster_features(level: DataFrame, means: Sequence[float], scales: Sequence[float], key: str = "po_num") -> DataFrame:
    """(key, features): imputed, scaled and weighted, in units."""

    def units(value: Column) -> Column:
        return F.floor(value * F.lit(float(UNIT)) + F.lit(0.5)).cast("long")

    scaled = [
        units((F.coalesce(c(n), F.lit(m)) - F.lit(m)) / F.lit(s) * F.lit(WEIGHTS.get(n, 1.0))) for n, m, s in zip(MEASURES, means, scales)
    ]
    return cluster_inputs(level, key).select(key, F.array(*scaled, *[units(c(n)) for n in (*SPARSE, *CODES)]).alias("features"))


def _first_centres(ready: DataFrame, ks: Sequence[int]) -> dict[int, list[list[int]]]:
    """k rows at even distances in the order of the first feature, the heaviest one."""
    placed = ordered.in_ranges(ready.select(c("features")[0].alias("_lead"), "po_num", "features"), [("_lead", "asc"), ("po_num", "asc")])
    sizes = ordered.range_sizes(placed)
    n = sum(size for _, size in sizes)
    at = {k: [(2 * j + 1) * n // (2 * k) for j in range(k)] for k in ks}
    rows = ordered.rows_at(placed, sizes, sorted({p for places in at.values() for p in places}))
    return {k: [list(rows[p]["features"]) for p in places] for k, places in at.items()}


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each point, the first of equals, and its squared distance."""
    best = np.zeros(len(points), np.int64)
    least = np.full(len(points), np.inf)
    for j, centre in enumerate(centres):
        distance = np.square(points - centre).sum(1)
        closer = distance < least
        best[closer], least[closer] = j, distance[closer]
    return best, least


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _sums(centres: dict[int, list[list[int]]]):
    """For each number of clusters and each cluster the rows nearest to it, their sums and squared distance."""
    known = {k: np.array(v, np.float64) for k, v in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            points = _points(batch.column(0))
            whole = points.astype(np.int64)
            for k, centre in known.items():
                best, least = _nearest(points, centre)
                for j in np.unique(best).tolist():
                    mine = best == j
                    held = totals.setdefault((k, j), [0, np.zeros(points.shape[1], np.int64), 0.0])
                    held[0] += int(mine.sum())
                    held[1] += whole[mine].sum(0)
                    held[2] += float(least[mine].sum())
        rows = [{"k": k, "cluster": j, "n": n, "sums": s.tolist(), "spread": d} for (k, j), (n, s, d) in totals.items()]
        schema = pa.schema([("k", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("spread", pa.float64())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _round(ready: DataFrame, centres: dict[int, list[list[int]]]) -> tuple[dict[int, list[list[int]]], dict[int, float]]:
    """Centres moved to the means of what is nearest to them, and the squared distances before the move. One pass
    for all numbers of clusters; a task passes on one row per centre."""
    parts = ready.select("features").mapInArrow(_sums(centres), "k int, cluster int, n long, sums array<long>, spread double")
    per_dim = parts.select("k", "cluster", "n", "spread", F.posexplode("sums").alias("dim", "s")).groupBy("k", "cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("spread").alias("spread")
    )
    moved = {k: [list(v) for v in held] for k, held in centres.items()}
    spread = dict.fromkeys(centres, 0.0)
    for r in per_dim.collect():  # a number per centre and feature
        moved[r["k"]][r["cluster"]][r["dim"]] = (2 * int(r["s"]) + r["n"]) // (2 * r["n"])
        spread[r["k"]] += r["spread"] if r["dim"] == 0 else 0.0
    return moved, spread


def _fit(level: DataFrame, ks: Sequence[int], share: float, seed: int, rounds: int) -> tuple[DataFrame, ClusterModel]:
    sample = stage(cluster_inputs(sample_rows(level, "po_num", share, seed)), "sample")
    means, scales = measure_scales(sample)
    ready = stage(cluster_features(sample, means, scales), "features")
    if ready.isEmpty():
        raise ValueError("no rows to fit clusters on")
    centres = _first_centres(ready, ks)
    for _ in range(rounds):
        moved, _ = _round(ready, centres)
        if moved == centres:
            break
        centres = moved
    return ready, ClusterModel(means, scales, centres)


def fit_centres(level: DataFrame, k: int = 5, share: float = 0.3, seed: int = 123, rounds: int = ROUNDS) -> ClusterModel:
    """k-means on a hash sample of the customers, from rows at even distances in lifetime value, for at most
    `rounds` rounds. Repeatable on any partitioning."""
    return _fit(level, [k], share, seed, rounds)[1]


def cluster_elbow(level: DataFrame, share: float = 0.3, seed: int = 123, largest: int = 9, rounds: int = ROUNDS) -> DataFrame:
    """Within-cluster sum of squares (two decimals) for one to `largest` clusters, all fitted in the same passes."""
    ready, model = _fit(level, range(1, largest + 1), share, seed, rounds)
    _, spread = _round(ready, model.centres)
    rows = [(k, math.floor(v / UNIT**2 * 100 + 0.5) / 100) for k, v in sorted(spread.items())]
    return level.sparkSession.createDataFrame(rows, "k int, inertia double")


def centre_table(spark: SparkSession, model: ClusterModel) -> DataFrame:
    """The centres as a table: k, cluster, feature, centre (in scaled and weighted units)."""
    rows = [(k, j, n, v / UNIT) for k, held in model.centres.items() for j, centre in enumerate(held) for n, v in zip(FEATURES, centre)]
    return spark.createDataFrame(rows, "k int, cluster int, feature string, centre double")


def _score(centres: list[list[int]]):
    known = np.array(centres, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _ = _nearest(_points(batch.column(1)), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32())], names=["po_num", "clusters"])

    return run


def customer_clusters(level: DataFrame, model: ClusterModel, k: int = 5) -> DataFrame:
    """Every customer's nearest centre. One pass over all segments at once; only the centres travel."""
    rows = cluster_features(level, model.means, model.scales).withColumn("po_num", c("po_num").cast("long"))
    return rows.mapInArrow(_score(model.centres[k]), "po_num long, clusters int")


# The same steps by the library's estimators, for models that are kept as pipelines.


def fit_clusters(level: DataFrame, k: int = 5, share: float = 0.3, seed: int = 123) -> tuple[PipelineModel, KMeansModel]:
    prep, ready = prepare_sample(level, share, seed)
    return prep, KMeans(k=k, seed=seed, featuresCol="features", predictionCol="clusters").fit(ready)


def predicted_clusters(level: DataFrame, prep: PipelineModel, model: KMeansModel) -> DataFrame:
    """Every customer's cluster by a fitted pipeline."""
    return model.transform(prep.transform(cluster_inputs(level))).select("po_num", "clusters")


CLUSTER_MEASURES: list[agg.Measure] = [
    ("customer_count", "count", "po_num", None, 0),
    *[(f"mean_{n}", "mean", n, None, 4) for n in ("cli_ltv", "cli_ltv_pre", "cli_ltv_post", "pol_count", "client_tenure", "cur_age", "mthly_incm", "coverage_ape", "inforce_pol")],
]


def cluster_profiles(level: DataFrame, clusters: DataFrame) -> DataFrame:
    return agg.profile(joins.join_merged(level, clusters, ["po_num"]), ["clusters"], CLUSTER_MEASURES)


def save_model(prep: PipelineModel, model: KMeansModel, path: str) -> None:
    prep.write().overwrite().save(f"{path}/preparation")
    model.write().overwrite().save(f"{path}/clusters")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, KMeansModel]:
    _ = spark  # the readers use the active session
    return PipelineModel.load(f"{path}/preparation"), KMeansModel.load(f"{path}/clusters")


def segment_clusters(level: DataFrame, clusters: DataFrame) -> DataFrame:
    """Customers per marketing segment and cluster; all segments were scored in one transform."""
    rows = level.select("po_num", "customer_segment").join(clusters, "po_num", "left")
    return agg.crosstab_counts(rows, ["customer_segment", "clusters"], "customers")
