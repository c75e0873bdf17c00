"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, the first by a hash of doc_id.

    Held-out documents never take part. Labels that are null are no labels; a document with several takes the
    largest. Only the chosen ids are broadcast: at most `rows`.
    """
    key = F.col("doc_id").cast("long")
    chosen = (
        labels.select(key.alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    texts = docs.select(key.alias("_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


def fold(doc_id: Column, parts: int) -> Column:
    """Part of a training row, for calibration on rows that the model has not seen."""
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(parts))
