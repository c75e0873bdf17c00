"""Helpers shared by the operators: reading, hashing words in numpy, walking sorted groups in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII characters: blank, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
#: Bytes hashed at once: small enough for the caches, and a bound on what a task holds besides its batch.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows per Arrow batch for this session. Texts can be long, so a batch must not hold thousands of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# Word hashes.

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_FACTORS = (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64; doubled as needed and kept."""
    while len(_POWERS[0]) < n:
        for k, factor in enumerate(_FACTORS):
            step = np.uint64(pow(int(factor), len(_POWERS[k]), 1 << 64))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * step])
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 of some texts in a row): about `limit` bytes, one text at least."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def words_of(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row: bytes joined by newlines, starts and ends of words, and bounds[i]:bounds[i+1] the
    words of text i. `lower` touches A-Z only."""
    joined = b"\n".join(raws)
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    return data, starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends]."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


_COEFFICIENTS = mix(np.arange(1, 33, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; as many as there are windows."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _COEFFICIENTS[j]
    return mix(out)


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; with fewer words the whole sequence
    counts as one shingle; without words the set is empty."""
    for _, raws in chunks(texts):
        data, starts, ends, bounds = words_of(raws)
        words = hash_spans(data, starts, ends)
        windows = window_hashes(words, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                got = np.sort(windows[a : b - k + 1])
                keep = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                yield got[keep]
            elif b > a:
                yield window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


# Groups in Arrow batches.


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by `keys`, one at a time; a group may span batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        change = np.zeros(part.num_rows, bool)
        for key in keys:
            col = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


# Bitmaps: sets of hashes in a fixed number of bits. A bit may stand for several hashes, so a test lets some
# others through; the exact join that follows drops them.

BITMAP_BITS = 25


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the long column `col`: 2**bits bits, whatever the number of rows."""
    place = F.col(col).bitwiseAND((1 << bits) - 1)
    rows = (
        df.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def in_bitmap(bitmap_: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.uint64) & np.uint64(len(bitmap_) * 8 - 1)
    return (bitmap_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
