"""From the documents table to shards for training: each stage works on all that the one before it kept.

Toxic documents go, one document of each group of near duplicates stays, documents with benchmark questions
go, sources are mixed to their target weights, and what is left is dealt into shards. All stages but the last
return the columns of documents; other columns of the input are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.llm.common import table
from tierline.llm.decontamination import clean
from tierline.llm.mixing import mixed_documents
from tierline.llm.ngram_join import Rule, ngram_components
from tierline.llm.sharding import shard
from tierline.llm.toxicity import toxicity
from tierline.sources.sink import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_hash(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumn("text_hash", F.xxhash64(text, text.isNull()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, by a model of the labelled ones among them. Each row goes by its own text,
    with or without a doc_id, whatever other rows share the doc_id."""
    docs = _text_hash(docs.select(COLUMNS))
    gone = toxicity(docs, table(spark, sf_dir, "labels"), carry=["text_hash"]).where("predicted = 1").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (docs["text_hash"] == gone["text_hash"])
    return docs.join(gone, same, "left_anti").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 over five-word shingles connect, one row stays: that of the
    least doc_id, null last, then of the least hash of the text; of rows alike in both, one. Documents without
    words stay."""
    rows = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    groups = ngram_components(rows.select(F.col("row").alias("doc_id"), "text"), Rule(words=5, num=80, den=100))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row")
    ordered = _text_hash(rows).select("row", order.alias("order"))
    members = groups.select(F.col("doc_id").alias("row"), "component_id")
    kept = members.join(ordered, "row").groupBy("component_id").agg(F.min("order").alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, be it with other numbers and names, go."""
    return clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixed_documents(docs.select(COLUMNS))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; repeats of a document stand in the same shard."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL can express neither the trained model nor the sampling; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
