"""Quality rules: countable base rules, and a logistic regression over hashed words and character n-grams.

The regression is trained on a bounded sample of labelled rows, its probability calibrated on a part of them
that it has not seen, and texts are scored in Arrow batches against fixed thresholds. A text's features are
the shares of its words and of its 4-byte windows that fall in each hash bucket, so a score is a mean of
weights and texts of any length take one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import chunks, hash_spans, small_batches, window_hashes, words_of
from tierline.llm.samples import fold, labelled_sample

#: Labelled rows that the model is trained on, at most; a quarter of them calibrates it.
SAMPLE = 4000
BITS = 17
ROUNDS = 120
#: Fixed thresholds.
LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_PROBABILITY = 0.35
_SCALE = 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _repeated(words: np.ndarray) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    windows = window_hashes(words, 3)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(windows)] |= twice
    return int(covered.sum())


def _repeated_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return count


def base_counts(texts: Sequence[str | None]) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = []
    for _, raws in chunks(texts):
        data, starts, ends, bounds = words_of(raws, lower=False)
        words = hash_spans(data, starts, ends)
        solid = np.concatenate([[0], np.cumsum(~_SPACE[data] & ((data & 0xC0) != 0x80))])
        symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        at = 0
        for raw, a, b in zip(raws, bounds[:-1].tolist(), bounds[1:].tolist()):
            end = at + len(raw)
            rows.append((b - a, solid[end] - solid[at], symbol[end] - symbol[at], _repeated_lines(raw), _repeated(words[a:b])))
            at = end + 1
    return np.array(rows, np.int64).reshape(-1, 5)


def features(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words and of the 4-byte windows of each text, lower case; windows follow the words."""
    mask, shift = np.uint64((1 << BITS) - 1), np.uint32(32 - BITS)
    for _, raws in chunks(texts):
        data, starts, ends, bounds = words_of(raws)
        words = (hash_spans(data, starts, ends) & mask).astype(np.int64)
        d = data.astype(np.uint32)
        n = max(0, len(d) - 3)
        grams = d[:n] | d[1 : n + 1] << np.uint32(8) | d[2 : n + 2] << np.uint32(16) | d[3 : n + 3] << np.uint32(24)
        grams = ((grams * np.uint32(2654435761)) >> shift).astype(np.int64) + (1 << BITS)
        at = 0
        for raw, a, b in zip(raws, bounds[:-1].tolist(), bounds[1:].tolist()):
            yield words[a:b], grams[at : max(at, at + len(raw) - 3)]
            at += len(raw) + 1


def margins(texts: Sequence[str | None], weights: np.ndarray) -> np.ndarray:
    return np.array(
        [_SCALE * ((weights[w].mean() if len(w) else 0.0) + (weights[g].mean() if len(g) else 0.0)) for w, g in features(texts)]
    )


def train(texts: Sequence[str | None], label: np.ndarray) -> np.ndarray:
    """Weights by bucket, the last one the bias: full-batch gradient descent with a step per weight."""
    size = 2 << BITS
    index, value, row = [], [], []
    for i, parts in enumerate(features(texts)):
        for part in parts:
            if len(part):
                found, count = np.unique(part, return_counts=True)
                index.append(found)
                value.append((_SCALE * count / len(part)).astype(np.float32))
                row.append(np.full(len(found), i, np.int32))
    weights, bias = np.zeros(size), 0.0
    if not index:
        return np.append(weights, bias)
    index, value, row = np.concatenate(index), np.concatenate(value), np.concatenate(row)
    positive = max(1.0, label.sum())
    cost = np.where(label == 1, len(label) / (2 * positive), len(label) / (2 * max(1.0, len(label) - label.sum())))
    moved, moved_bias = np.full(size, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(row, value * weights[index], len(label)) + bias
        error = cost * (1 / (1 + np.exp(-z)) - label) / len(label)
        slope = np.bincount(index, value * error[row], size) + 1e-6 * weights
        moved += slope**2
        moved_bias += error.sum() ** 2
        weights -= 0.3 * slope / np.sqrt(moved)
        bias -= 0.3 * error.sum() / np.sqrt(moved_bias)
    return np.append(weights, bias)


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make 1 / (1 + exp(-(a z + b))) a probability, by Newton's method on smoothed labels."""
    if not len(z) or label.min() == label.max():
        return 1.0, 0.0
    up, down = label.sum(), len(label) - label.sum()
    t = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = pa.Table.from_batches(list(batches)).sort_by("_id").to_pydict() if batches else {}
    texts, label, part = sample.get("text", []), np.array(sample.get("label", [])), np.array(sample.get("part", []))
    if len(label) == 0 or label.min() == label.max():
        return
    fit, rest = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    if len({*label[fit].tolist()}) < 2:
        fit = np.arange(len(label))
    weights = train([texts[i] for i in fit], label[fit])
    z = margins([texts[i] for i in rest], weights[:-1]) + weights[-1]
    model = np.append(weights, calibrate(z, label[rest]))
    yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float32).tobytes()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> np.ndarray | None:
    """Weights, bias, slope, offset of the model of `labels.quality`; None without rows of both kinds. One
    task trains on the bounded sample; the model has a fixed size."""
    sample = labelled_sample(docs, labels, "quality", rows).withColumn("part", fold(F.col("_id"), 4))
    schema = "model binary"
    found = sample.repartition(1).mapInArrow(_nonempty(_fit), schema).collect()
    return np.frombuffer(bytes(found[0]["model"]), np.float32).astype(float) if found else None


def _nonempty(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from fn(held)

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = base_counts(texts)
            words, repeated = counts[:, 0], counts[:, 4]
            failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
            if m is None:
                p = np.ones(len(texts))
            else:
                z = margins(texts, m[:-3]) + m[-3]
                p = 1 / (1 + np.exp(-np.clip(m[-2] * z + m[-1], -30, 30)))
            kept = ~failed & (p >= LEAST_PROBABILITY)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(p, pa.float64())],
                names=["doc_id", *names, "base_failed", "kept", "probability"],
            )

    return run


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for
    each row of `docs` (doc_id, text), by a model of `labels` (doc_id, quality).

    A null text has no words, so it fails the base rules, as an empty one does. Null and repeated doc_ids are
    rows like others. Without labelled rows of both kinds there is no model and the probability is 1: the
    base rules decide alone. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return texts.mapInArrow(_score(model), schema)
