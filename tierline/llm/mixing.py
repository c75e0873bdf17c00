"""Mixing sources to target weights by cube-method balanced sampling.

A source with target t and size s is taken floor(t / s) times in whole; one more copy of a document is drawn
with the inclusion probability that is left. Of n equal rows floor(n * probability) are taken once more outright
and one more is drawn with the rest. The draw is balanced on two totals per source, words and
documents: three documents at a time, their probabilities move along the null space of the two constraints
until one of them reaches 0 or 1 (flight). Blocks of a source fly on their own, at most two documents of a
block stay undecided, and those of many blocks fly together at the next level, until one block per source is
left and its last two documents are settled by the nearest words total (landing).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import grouped, small_batches, word_count
from tierline.operators.ordered import running
from tierline.sources.sink import stage

#: Weights in turn, for sources in order of code point, null last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents in a block.
BLOCK = 4096
_EDGE = 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: `share` of all by weight, none above `most` times its size. What is
    above is shared by weight among the others, again and again."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / total
        above = [i for i in open_ if out[i] > most * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def _direction(rows: list[list[float]]) -> list[float] | None:
    """A move of up to three units that changes neither total; None if there is none. A row: words, documents."""
    if len(rows) == 3:
        (a, m), (b, n), (c, o) = rows
        v = [b * o - c * n, c * m - a * o, a * n - b * m]
        if any(abs(x) > _EDGE for x in v):
            return v
        return [n, -m, 0.0]  # all in proportion: two of them balance both
    if len(rows) == 2:
        (a, m), (b, n) = rows
        if abs(a * n - b * m) <= _EDGE:
            return [n, -m]
    return None


def fly(words: np.ndarray, copies: np.ndarray, chance: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for at most two units."""
    out = chance.astype(float).copy()
    draws = iter(np.random.default_rng(list(seed)).random(2 * len(out) + 8).tolist())
    active: list[int] = []
    queue = iter(np.flatnonzero((out > _EDGE) & (out < 1 - _EDGE)).tolist())
    out[out <= _EDGE], out[out >= 1 - _EDGE] = 0.0, 1.0
    while True:
        while len(active) < 3 and (unit := next(queue, None)) is not None:
            active.append(unit)
        v = _direction([[float(words[i]), float(copies[i])] for i in active])
        if v is None:
            return out
        up = min((1 - out[i]) / x if x > 0 else out[i] / -x for i, x in zip(active, v) if x)
        down = min(out[i] / x if x > 0 else (1 - out[i]) / -x for i, x in zip(active, v) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(active, v):
            out[i] += step * x
        for i in list(active):
            if out[i] <= _EDGE or out[i] >= 1 - _EDGE:
                out[i] = round(out[i])
                active.remove(i)


def land(words: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Settle what the flight left by the choice whose words are nearest the expected ones."""
    out = chance.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    want = float((words[left] * out[left]).sum())
    choices = [[(k >> j) & 1 for j in range(len(left))] for k in range(1 << len(left))]
    best = min(choices, key=lambda c: (abs(sum(x * w for x, w in zip(c, words[left].tolist())) - want), c))
    out[left] = best
    return out


def _flight(level: int, last: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["place", "block"]):
            place, block = group["place"][0].as_py(), group["block"][0].as_py()
            words, copies = group["words"].to_numpy(), group["copies"].to_numpy()
            chance = fly(words, copies, group["chance"].to_numpy(), [place, block, level])
            if place in last:
                chance = land(words, chance)
            at = group.schema.get_field_index("chance")
            yield from group.set_column(at, "chance", pa.array(chance)).combine_chunks().to_batches()

    return run


def _units(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, source, text) and the number of rows alike in all three."""
    text = F.col("text").cast("string")
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(text, text.isNull()).alias("text_hash"),
        )
        .groupBy("doc_id", "source", "size", "text_hash")
        .agg(F.count("*").alias("copies"))
    )


def mix_units(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, text_hash, copies, source_size, target, times, more): each of `copies` equal rows
    is taken `times` times, and `more` of them once more. One row per source comes to the driver."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    units = stage(_units(docs), "units")
    found = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("s"), F.count("*").alias("c")
    ).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["s"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    rows, blocks = [], {}
    for i, (r, t) in enumerate(zip(found, aims)):
        rate = t / r["s"] if r["s"] else 0.0
        blocks[i] = max(1, -(-r["c"] // BLOCK))
        rows.append((r["source"], i, r["s"], float(t), int(rate), rate - int(rate), blocks[i]))
    sources = spark.createDataFrame(
        rows, "source string, place int, source_size long, target double, whole long, chance double, blocks long"
    )
    units = units.join(F.broadcast(sources), units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keys = ["doc_id", "source", "size", "text_hash"]
    # of equal rows only what is left of one copy takes part in the draw
    units = units.withColumn("outright", F.floor(F.col("chance") * F.col("copies")))
    now = units.withColumn("rest", F.col("chance") * F.col("copies") - F.col("outright")).where("size > 0 and rest > 0").select(
        *keys, "place", F.expr("pmod(xxhash64(doc_id, text_hash), blocks)").alias("block"),
        F.col("size").alias("words"), F.lit(1).cast("long").alias("copies"), F.col("rest").alias("chance"),
    )
    level, settled = 0, []
    while True:
        last = {i for i, b in blocks.items() if b == 1}
        flown = stage(
            now.repartition("place", "block")
            .sortWithinPartitions("place", "block", F.xxhash64("doc_id", "text_hash"), *keys)
            .mapInArrow(_flight(level, last), now.schema),
            "flown",
        )
        settled.append(flown.where("chance = 0 or chance = 1"))
        if len(last) == len(blocks):
            break
        # two units of each block are left at most
        blocks = {i: -(-b * 2 // BLOCK) for i, b in blocks.items() if b > 1}
        level += 1
        open_ = spark.createDataFrame([(i, b) for i, b in blocks.items()], "place int, next long")
        now = (
            flown.where("chance > 0 and chance < 1")
            .join(F.broadcast(open_), "place")
            .withColumn("block", F.expr("pmod(xxhash64(doc_id, text_hash), next)"))
            .select(now.columns)
        )
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.union(more)
    drawn = drawn.select(*keys, F.col("chance").cast("long").alias("extra"))
    same = [units[k].eqNullSafe(drawn[k]) for k in keys]
    return units.join(drawn, same, "left").select(
        *[units[k] for k in keys], "copies", "source_size", "target",
        F.col("whole").cast("long").alias("times"), (F.col("outright") + F.coalesce("extra", F.lit(0))).alias("more"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of `docs` (doc_id, text, source).

    A null or empty text has no words and nothing is taken of it. Null is a source of its own. Of rows that are
    alike in doc_id, source and text some may be taken once more than others, as the target asks; null doc_ids
    are documents like others. A source
    without words has target 0. No documents give no rows. Reruns give the same rows, whatever the
    partitioning.
    """
    units = mix_units(docs, weights, share, most)
    return units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("times") + (F.col("copy") <= F.col("more")).cast("long"))).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; documents without words are not taken.

    Equal rows that are not all taken alike are numbered in the order of a hash of all their columns; the first
    are taken once more. The numbering is spread over ranges, so that many equal rows do not meet in one task.
    """
    units = stage(mix_units(docs, weights, share, most).where("size > 0 and times + more > 0"), "taken")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.xxhash64(text, text.isNull()).alias("text_hash"),
    )
    keys = ["doc_id", "source", "text_hash"]

    def of(chosen: DataFrame) -> DataFrame:
        same = [rows[k].eqNullSafe(chosen[k]) for k in keys]
        return rows.join(chosen, same).select(*[rows[k] for k in keys], "row", "times", "more")

    alike = units.withColumn("times", F.col("times") + (F.col("more") == F.col("copies")).cast("long")).where("more in (0, copies) and times > 0")
    out = of(alike).select("row", "times")
    parted = units.where("more > 0 and more < copies")
    if not parted.isEmpty():
        placed = stage(
            of(parted).select("*", F.xxhash64(F.to_json("row")).alias("order"), F.monotonically_increasing_id().alias("id"), F.lit(1).alias("one")),
            "parted",
        )
        counted = running(placed, keys, [("order", "asc"), ("id", "asc")], "one", "sum", "nth")
        out = out.union(counted.select("row", F.col("times") + (F.col("nth") <= F.col("more")).cast("long")))
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
