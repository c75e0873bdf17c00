"""Importance resampling towards a target distribution, over hashed n-grams found by an Aho-Corasick automaton.

The automaton holds ` word ` for each word of a dictionary, blanks included, so that it reports whole words only.
Each word carries the CRC-32 and the length of its UTF-8 bytes. A scan of a text emits these payloads in order, and
the CRC of an n-gram is composed from those of adjacent words by the shift of the prefix over the next length, so
that no n-gram is ever built as text. The dictionary has a fixed size and only decides how fast a word is found:
words outside it are met in the gaps between hits, and their payloads are computed on the spot.

Features are hashed into buckets, counted over all documents and over the target, and each document is scored by
the sum of its features' log ratios plus Gumbel noise, so that the highest scores are a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import small_batches
from tierline.operators.ordered import in_ranges, range_sizes
from tierline.sources.sink import stage

#: Words in the dictionary, the longest of them in bytes, and the documents it is drawn from (about).
DICTIONARY = 1 << 15
LONGEST = 32
SAMPLE = 4000
#: Distinct words that a task counts before it passes them on.
FLUSH = 200_000


@dataclass(frozen=True)
class Features:
    """Runs of `least` to `most` consecutive words, hashed into `buckets`."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000


#: A-Z are lower-cased, a-z, 0-9 and all bytes of other characters are kept, the rest are delimiters.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


# Composition of CRCs.

_ONES = 0xFFFFFFFF
_BLANK = np.uint32(zlib.crc32(b" "))


@lru_cache(256)
def _shift(n: int) -> list[np.uint32]:
    """What each bit of a CRC becomes when n bytes follow; the map is linear."""
    zeros = bytes(n)
    return [np.uint32(zlib.crc32(zeros, 1 << bit ^ _ONES) ^ _ONES) for bit in range(32)]


def combine(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and the length of B."""
    out = second.astype(np.uint32)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        here = first[at].astype(np.uint32)
        for bit, image in enumerate(_shift(n)):
            out[at] ^= np.where(here >> np.uint32(bit) & np.uint32(1), image, np.uint32(0))
    return out


def ngram_crcs(crc: np.ndarray, length: np.ndarray, least: int, most: int) -> np.ndarray:
    """CRCs of all runs of `least` to `most` words, joined by one blank."""
    found, run = [], crc
    for n in range(1, most + 1):
        if n > 1:
            if len(crc) < n:
                break
            run = combine(run[:-1], np.full(len(run) - 1, _BLANK), np.ones(len(run) - 1, np.int64))
            run = combine(run, crc[n - 1 :], length[n - 1 :])
        if n >= least:
            found.append(run)
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


# The dictionary.


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        short = [(w, c) for w, c in counts.items() if len(w) <= LONGEST]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w, _ in short], pa.string()), pa.array([c for _, c in short], pa.int64())], names=["word", "c"]
        )

    for batch in batches:
        for text in batch.column(0):
            counts.update(folded(text.as_py()).split(b" "))
            if len(counts) > FLUSH:
                yield rows()
    yield rows()


def dictionary(texts: DataFrame, size: int = DICTIONARY, sample: int = SAMPLE) -> list[str]:
    """The most frequent words of a random sample of about `sample` texts: `size` words at most, none longer than
    LONGEST bytes. Results do not depend on it."""
    n = texts.count()
    some = texts.sample(min(1.0, sample / n), 7) if n > sample else texts
    top = (
        some.mapInArrow(_count_words, "word string, c long").where("word <> ''")
        .groupBy("word").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "word").limit(size)
    )
    return [r["word"] for r in top.collect()]


class Scanner:
    """Payloads of the words of a text, in order."""

    def __init__(self, words: list[str]):
        raws = [w.encode() for w in words]
        self.crc = np.array([zlib.crc32(r) for r in raws], np.uint32)
        self.length = np.array([len(r) for r in raws], np.int64)
        self.chars = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word} ", i)
        self.automaton.make_automaton()

    def payloads(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length in bytes) of each word."""
        s = f" {folded(text).decode()} "
        hits = self.automaton.iter(s) if self.automaton.kind == ahocorasick.AHOCORASICK else ()
        found = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
        end, word = found[:, 0], found[:, 1]
        start = end - self.chars[word] if len(word) else end
        crc, length = self.crc[word], self.length[word]
        before = np.append(0, end)
        gaps = np.flatnonzero(np.append(start, len(s)) - before > 1)
        at, crcs, lengths = [], [], []
        starts, ends = np.append(start, len(s))[gaps].tolist(), before[gaps].tolist()
        for i, a, b in zip(gaps.tolist(), ends, starts):
            for raw in s[a:b].encode().split(b" "):
                if raw:
                    at.append(i)
                    crcs.append(zlib.crc32(raw))
                    lengths.append(len(raw))
        if at:
            crc = np.insert(crc, at, np.array(crcs, np.uint32))
            length = np.insert(length, at, lengths)
        return crc, length

    def buckets(self, text: str | None, kind: Features) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each feature."""
        crc, length = self.payloads(text)
        return len(crc), ngram_crcs(crc, length, kind.least, kind.most).astype(np.int64) % kind.buckets


def _counts(words, kind: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words.value)
        counts = np.zeros(kind.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(scanner.buckets(text.as_py(), kind)[1], minlength=kind.buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["bucket", "c"])

    return run


def bucket_counts(texts: DataFrame, words, kind: Features) -> list[int]:
    """Features per bucket over all texts: a list of `kind.buckets` numbers."""
    out = [0] * kind.buckets
    rows = texts.mapInArrow(_counts(words, kind), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    for r in rows.collect():
        out[r["bucket"]] = r["c"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * log ratio) of target to source per bucket, each count plus one."""
    m, s, t = len(source), float(sum(source)), float(sum(target))
    ratio = [(b + 1.0) * (s + m) / ((a + 1.0) * (t + m)) for a, b in zip(source, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * Gumbel) drawn from a hash of the seed and doc_id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(words, gain, kind: Features, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, value = Scanner(words.value), gain.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = np.zeros((4, len(ids)), np.int64)
            for i, text in enumerate(batch.column(1)):
                n, buckets = scanner.buckets(text.as_py(), kind)
                weight = int(value[buckets].sum())
                out[:, i] = n, len(buckets), weight, weight + noise(ids[i], seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight", "score"]
            )

    return run


def resample(
    docs: DataFrame, target: DataFrame, kind: Features = Features(), percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of `docs` (doc_id, text; other columns are ignored).

    Of the documents with `least_words` words or more, `percent` in 100 (rounded down) with the highest scores are
    drawn and ranked 1, 2, 3 ...; the rest have no rank. Ties go to the smaller doc_id, null last; rows alike in
    both take neighbouring ranks, those with fewer features first. A null or empty text has no features and weight
    0; a null doc_id draws its noise from an empty id. Rows that repeat a doc_id are rows of their own and share
    their noise. An empty target gives weights against a flat one; no documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("text")
    words = spark.sparkContext.broadcast(dictionary(texts))  # DICTIONARY words of LONGEST bytes at most
    source = bucket_counts(texts, words, kind)
    wanted = bucket_counts(target.select(F.col("text").cast("string")), words, kind)
    gain = spark.sparkContext.broadcast(gains(source, wanted))  # one number per bucket
    scored = docs.mapInArrow(_scores(words, gain, kind, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    scored = stage(scored, "scored").withColumn("_row", F.monotonically_increasing_id())
    order = [("score", "desc"), ("doc_id", "asc"), ("n_features", "asc"), ("_row", "asc")]
    ranged = in_ranges(scored.where(F.col("n_words") >= least_words), order)
    sizes = range_sizes(ranged)
    drawn = sum(size for _, size in sizes) * percent // 100
    starts, seen = [], 0
    for number, size in sizes:
        starts.append((number, seen))
        seen += size
    starts = spark.createDataFrame(starts, "_range int, _start long")  # one row per range
    place = F.col("_start") + F.col("_at") + 1
    ranked = ranged.join(F.broadcast(starts), "_range").withColumn("rank", F.when(place <= drawn, place))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(out).union(short.select(out))
