"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexica of words and stems, nearness of their hits to a second person, and rates of
capitals, punctuation and obfuscation. The lexica are learned from the labelled sample: words, and stems of
four and five bytes, that toxic texts have far more often. Features are computed in Arrow batches; trees and
calibration are Spark's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import chunks, hash_spans, held_out, small_batches
from tierline.llm.samples import fold, labelled_sample
from tierline.sources.sink import stage

#: Labelled rows that lexica and trees are trained on, at most; a fifth of them calibrates.
SAMPLE = 10_000
#: Entries of a lexicon, at most, and the least number of toxic texts an entry is in.
ENTRIES, LEAST_TEXTS = 4096, 4
TREES, DEPTH = 15, 3
#: Words between a hit and a second person that count as near.
NEAR = 5
#: Second persons, by language.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
#: Characters that stand for a letter inside a word, and the letters.
LEET = ("013457@$!", "oieastasi")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_AS_LETTER = np.arange(256, dtype=np.uint8)
_AS_LETTER[list(LEET[0].encode())] = list(LEET[1].encode())
_LEET = np.zeros(256, bool)
_LEET[list(LEET[0].encode())] = True
_STEMS = (0, 5, 4)
NAMES = ["log_words"] + [f"{n}_{k}" for k in ("word", "stem5", "stem4") for n in ("density", "weight", "count")] + [
    "near_second_person", "near_share", "capitals", "capital_words", "marks", "marks_in_row", "obfuscated", "obfuscated_hits",
]

Lexicon = tuple[np.ndarray, np.ndarray]


class Tokens:
    """Words of some texts: letter runs in lower case, with single look-alike characters between letters read
    as letters. `owner` is the text of each."""

    def __init__(self, raws: list[bytes]):
        joined = b"\n".join(raws)
        self.data = np.frombuffer(joined, np.uint8)
        letter = _LETTER[self.data]
        inner = np.zeros(len(letter), bool)
        if len(letter) > 2:
            inner[1:-1] = _LEET[self.data[1:-1]] & letter[:-2] & letter[2:]
        self.inner = inner
        lowered = np.frombuffer(joined.lower(), np.uint8)
        lowered = np.where(inner, _AS_LETTER[lowered], lowered)
        solid = np.zeros(len(letter) + 2, np.int8)
        solid[1:-1] = letter | inner
        edge = np.diff(solid)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        # hashes of whole words, and of their first bytes where they have more
        self.hashes = [hash_spans(lowered, self.starts, self.ends)]
        for k in _STEMS[1:]:
            self.hashes.append(hash_spans(lowered, self.starts, np.minimum(self.ends, self.starts + k)))


def _hash_words(words: str) -> np.ndarray:
    return np.sort(Tokens([words.encode()]).hashes[0])


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def lexica(texts: Sequence[str | None], label: Sequence[int]) -> list[Lexicon]:
    """(sorted hashes, weights) of words and stems by their log odds over texts."""
    label = np.asarray(label)
    seen: list[list[np.ndarray]] = [[] for _ in _STEMS]
    marks: list[list[np.ndarray]] = [[] for _ in _STEMS]
    for first, raws in chunks(texts):
        tokens = Tokens(raws)
        for k, hashes in enumerate(tokens.hashes):
            order = np.lexsort((tokens.owner, hashes))
            h, o = hashes[order], tokens.owner[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            seen[k].append(h[once])
            marks[k].append(label[first + o[once]])
    toxic, clean = max(1, int(label.sum())), max(1, int((label == 0).sum()))
    out = []
    for s, m in zip(seen, marks):
        h = np.concatenate(s) if s else np.zeros(0, np.uint64)
        values, inverse = np.unique(h, return_inverse=True)
        pos = np.bincount(inverse, np.concatenate(m) if m else None, len(values)) if len(h) else np.zeros(0)
        neg = np.bincount(inverse, minlength=len(values)) - pos if len(h) else np.zeros(0)
        weight = np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1))
        keep = np.flatnonzero((pos >= LEAST_TEXTS) & (weight >= np.log(8.0)))
        keep = keep[np.lexsort((values[keep], -pos[keep]))[:ENTRIES]]
        keep.sort()
        out.append((values[keep], weight[keep]))
    return out


def dense(texts: Sequence[str | None], known: Sequence[Lexicon]) -> np.ndarray:
    """A row of NAMES for each text."""
    second = _hash_words(SECOND_PERSON)
    out = []
    for _, raws in chunks(texts):
        t = Tokens(raws)
        n = len(raws)
        total = lambda mask_or_weights, owner=t.owner: np.bincount(owner, mask_or_weights, n)
        words = np.bincount(t.owner, minlength=n)
        per_word = 1 / np.maximum(words, 1)
        columns = [np.log1p(words)]
        any_hit = np.zeros(len(t.owner), bool)
        for (table, weight), hashes in zip(known, t.hashes):
            hit, at = _found(table, hashes)
            any_hit |= hit
            w = np.where(hit, weight[at], 0.0) if len(table) else np.zeros(len(hit))
            count = total(hit)
            columns += [100 * count * per_word, total(w) * per_word, count]
        near = np.zeros(len(t.owner), bool)
        you, hits = np.flatnonzero(_found(second, t.hashes[0])[0]), np.flatnonzero(any_hit)
        if len(you) and len(hits):
            right = np.searchsorted(you, hits)
            for at in (np.maximum(right - 1, 0), np.minimum(right, len(you) - 1)):
                near[hits] |= (np.abs(you[at] - hits) <= NEAR) & (t.owner[you[at]] == t.owner[hits])
        columns += [100 * total(near) * per_word, total(near) / np.maximum(total(any_hit), 1)]
        upper = (t.data >= 65) & (t.data <= 90)
        byte_owner = np.repeat(np.arange(n), np.diff(t.offsets))[: len(t.data)]
        letters = np.maximum(np.bincount(byte_owner, _LETTER[t.data], n), 1)
        ups = np.concatenate([[0], np.cumsum(upper)])
        lengths = t.ends - t.starts
        mark = (t.data == 33) | (t.data == 63)
        in_row = mark.copy()
        in_row[1:] &= mark[:-1]
        in_row[:1] = False
        inside = np.concatenate([[0], np.cumsum(t.inner)])
        odd = inside[t.ends] > inside[t.starts]
        size = np.maximum(np.bincount(byte_owner, minlength=n), 1)
        columns += [
            np.bincount(byte_owner, upper, n) / letters,
            total((ups[t.ends] - ups[t.starts] == lengths) & (lengths > 2)) * per_word,
            100 * np.bincount(byte_owner, mark, n) / size,
            100 * np.bincount(byte_owner, in_row, n) / size,
            100 * total(odd) * per_word,
            total(odd & any_hit),
        ]
        out.append(np.stack(columns, 1))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        sample = pa.Table.from_batches(held).sort_by("_id").to_pydict()
        for k, (values, weights) in enumerate(lexica(sample["text"], sample["label"])):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(weights)],
                names=["kind", "hash", "weight"],
            )


def _featurise(known, keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dense(batch.column("text").to_pylist(), known.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(rows[:, i]) for i in range(len(NAMES)))], names=[*keep, *NAMES]
            )

    return run


_COLUMNS = ", ".join(f"{n} double" for n in NAMES)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text), learned from `labels`
    (doc_id, toxic) of documents that are not held out. Columns of `docs` named in `carry` come along.

    A null text scores as an empty one. Null and repeated doc_ids are rows like others; a null doc_id counts
    as held out. If the labelled rows are all of one kind, every score is their share of toxic ones; without
    any it is 0. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, "toxic", rows).withColumn("part", fold(F.col("_id"), 5).cast("int"))
    sample = stage(sample.withColumn("label", F.least(F.greatest("label", F.lit(0)), F.lit(1))), "toxic-sample")
    shares = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    key = F.col("doc_id").cast("long")
    texts = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col("text").cast("string").alias("text"), *carry)
    if len(shares) < 2:
        share = float(shares.get(1, 0) > 0)
        return texts.select("doc_id", *carry, "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    found = sample.where("part > 0").repartition(1).mapInArrow(_learn, "kind int, hash long, weight double").collect()
    known = []
    for k in range(len(_STEMS)):
        own = sorted((r["hash"] % (1 << 64), r["weight"]) for r in found if r["kind"] == k)
        known.append((np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own], float)))
    known = spark.sparkContext.broadcast(known)
    gather = VectorAssembler(inputCols=NAMES, outputCol="features")
    trained = stage(
        sample.mapInArrow(
            _featurise(known, ["label", "part"]), f"label int, part int, {_COLUMNS}"
        ),
        "toxic-features",
    )
    ready = gather.transform(trained).withColumn("label", F.col("label").cast("double"))
    fit_rows = ready.where("part > 0")
    if fit_rows.select("label").distinct().count() < 2:
        fit_rows = ready
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(fit_rows)
    raw = lambda df: df.withColumn("raw", vector_to_array("probability")[1])
    judged = raw(trees.transform(ready.where("part = 0"))).select("label", "raw")
    if judged.isEmpty():
        judged = raw(trees.transform(ready)).select("label", "raw")
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(judged)
    carried = "".join(f"`{c}` {t}, " for c, t in texts.select(*carry).dtypes)
    features = texts.mapInArrow(_featurise(known, ["doc_id", *carry, "held_out"]), f"doc_id long, {carried}held_out boolean, {_COLUMNS}")
    scored = steps.transform(raw(trees.transform(gather.transform(features))).drop("prediction"))
    # a little of the trees' own order breaks ties within a step
    score = F.least(F.greatest(0.99 * F.col("prediction") + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", *carry, "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
