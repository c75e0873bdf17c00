"""Near duplicates by SimHash fingerprints, with pigeonring filtering.

A fingerprint is cut into m consecutive segments on a ring, and segment i gets a budget t(i); the budgets sum to
`bits - m + 1`. If two fingerprints differ in `bits` bits or fewer, some segment starts a chain whose differences,
summed over its first l segments, stay within the sum of their budgets plus l - 1, for every l up to m. The first
link of the chain is the key that brings candidates together (fingerprints meet in each segment, within its
budget); the longer chains prune pairs before the full comparison. Nothing is lost: the chain condition is
necessary. The fewer segments, the longer their keys: m falls as the number of fingerprints grows, so that groups
by chance stay small, and groups that are large all the same (many copies) are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import chunks, grouped, small_batches
from tierline.llm.components import components
from tierline.sources.sink import stage

WIDTH = 64
SEED = 42
#: Members of a segment's group that chance alone should bring together; beyond it segments get longer.
BY_CHANCE = 256
#: Members of a block.
BLOCK = 2048


@dataclass(frozen=True)
class Ring:
    """Consecutive segments (first bit, number of bits, budget) of a fingerprint, for links of `bits` bits."""

    bits: int
    segments: tuple[tuple[int, int, int], ...]

    @classmethod
    def cut(cls, bits: int, m: int) -> Ring:
        sizes = [WIDTH // m + (i < WIDTH % m) for i in range(m)]
        spare = bits - m + 1
        budgets = [spare // m + (i >= m - spare % m) for i in range(m)]
        firsts = [sum(sizes[:i]) for i in range(m)]
        return cls(bits, tuple(zip(firsts, sizes, budgets)))

    @classmethod
    def for_count(cls, bits: int, n: int) -> Ring:
        """As many segments as keep the groups of n fingerprints small, `bits + 1` at most."""
        m = bits + 1
        while m > 2 and n / 2 ** (WIDTH // m) > BY_CHANCE:
            m -= 1
        return cls.cut(bits, m)

    def masks(self) -> list[np.uint64]:
        return [np.uint64(((1 << size) - 1) << first) for first, size, _ in self.segments]


# Fingerprints.


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    counts = np.zeros(WIDTH, np.int64)
    for a in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[a : a + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def shingle_hashes(raw: bytes, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the k-word shingles of UTF-8 text, repeats included, words lower-cased (A-Z) and joined by a
    blank; fewer words are one shingle, none give none. `bytes.split` cuts at the ASCII blanks of WORD."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    found = map(xxhash.xxh64_intdigest, map(b" ".join(words).__getitem__, spans), repeat(seed))
    return np.fromiter(found, np.uint64, len(words) - k + 1)


def _print(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raws in chunks([t.as_py() for t in batch.column(1)]):
                out += [fingerprint(shingle_hashes(raw, k)) for raw in raws]
            prints = pa.array(np.array(out, np.uint64).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, print): the fingerprint of each row as a signed long; zero without words, null texts included."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_print(words), "doc_id long, print long")


# Candidates.


def _flips(size: int, budget: int) -> list[int]:
    """Masks of 1 to `budget` of `size` bits."""
    return [sum(1 << b for b in bits) for n in range(1, budget + 1) for bits in combinations(range(size), n)]


def _members(prints: DataFrame, ring: Ring) -> DataFrame:
    """(spot, print, own): the groups a fingerprint belongs to. In the group of its own key it is `own`; into
    groups of keys within the budget it comes as a visitor."""
    found = None
    for i, (first, size, budget) in enumerate(ring.segments):
        key = F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << size) - 1))
        keys = [F.struct(F.lit(0).cast("long").alias("flip"), F.lit(True).alias("own"))]
        keys += [F.struct(F.lit(f).cast("long").alias("flip"), F.lit(False).alias("own")) for f in _flips(size, budget)]
        part = prints.select("print", key.alias("key"), F.explode(F.array(*keys)).alias("k")).select(
            F.col("key").bitwiseXOR(F.col("k.flip")).bitwiseOR(F.lit(i << WIDTH // 2)).alias("spot"), "print", F.col("k.own").alias("own")
        )
        found = part if found is None else found.union(part)
    return found


def viable(ring: Ring, start: int, xor: np.ndarray) -> np.ndarray:
    """Indices of differences with a chain that starts at a segment and whose whole difference is near enough."""
    masks, m = ring.masks(), len(ring.segments)
    at = np.arange(len(xor))
    total, budget = np.zeros(len(xor), np.int64), 0
    for step in range(m):
        i = (start + step) % m
        total = total + np.bitwise_count(xor[at] & masks[i])
        budget += ring.segments[i][2]
        keep = total <= budget + step
        at, total = at[keep], total[keep]
    return at  # after m segments the budget is `bits`: the full Hamming check


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index each of n indices is connected with by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _link(ring: Ring):
    """Edges that join the linked members of each block, at most one per member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["spot", "block"]):
            start = group["spot"][0].as_py() >> WIDTH // 2
            prints = group["print"].to_numpy().astype(np.int64).view(np.uint64)
            own = np.flatnonzero(group["own"].to_numpy(zero_copy_only=False))
            if not len(own) or len(prints) < 2:
                continue
            left, right = [], []
            rows = max(1, (1 << 20) // len(prints))
            for a in range(0, len(own), rows):
                mine = own[a : a + rows]
                hit = viable(ring, start, (prints[mine, None] ^ prints[None, :]).reshape(-1))
                left.append(mine[hit // len(prints)])
                right.append(hit % len(prints))
            root = _roots(len(prints), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(prints != prints[root])
            if len(moved):
                ends = [pa.array(prints[x].view(np.int64)) for x in (moved, root[moved])]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return run


def _edges(jobs: DataFrame, ring: Ring) -> DataFrame:
    return (
        jobs.select("spot", "block", "print", "own")
        .repartition("spot", "block")
        .sortWithinPartitions("spot", "block")
        .mapInArrow(_link(ring), "a long, b long")
    )


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """Members with their block. In a group of several blocks the first own member is in each of them, so that
    what is linked with it is known to be one before blocks meet."""
    large = (
        members.groupBy("spot")
        .agg(F.count("*").alias("k"), F.min(F.when(F.col("own"), F.col("print"))).alias("leader"))
        .where((F.col("k") > size) & F.col("leader").isNotNull())
        .select("spot", "leader", F.ceil(F.col("k") / size).cast("long").alias("blocks"))
    )
    joined = members.join(large, "spot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.array(F.expr("pmod(xxhash64(print), blocks)"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    leads = F.col("own") & F.col("leader").eqNullSafe(F.col("print"))
    return joined.withColumn("block", F.explode(F.when(leads, every).otherwise(mine)))


def _across(blocks: DataFrame, comps: DataFrame, size: int) -> DataFrame:
    """Jobs that bring the members outside the main component of a large group together with all members of the
    group. Members of the main component are one already and are not compared with each other again."""
    once = blocks.where("blocks > 1").select("spot", "print", "own", "blocks").distinct()
    many = (
        once.join(comps.withColumnRenamed("node", "print"), "print", "left")
        .withColumn("comp", F.coalesce("root", "print"))
        .select("spot", "print", "own", "blocks", "comp")
    )
    main = (
        many.groupBy("spot", "comp").agg(F.count("*").alias("c"))
        .groupBy("spot").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    )
    rest = many.join(main, "spot").where("comp <> main").select("spot", "print", "own", "blocks")
    parts = rest.groupBy("spot").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 2 / size)).cast("long").alias("parts"))
    number = F.expr("part * blocks * 2 + slice").alias("block")
    rest_side = (
        rest.join(parts, "spot")
        .withColumn("part", F.expr("pmod(xxhash64(print, 1), parts)"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") * 2 - 1)))
        .select("spot", number, "print", "own")
    )
    all_side = (
        many.join(parts, "spot")
        .withColumn("slice", F.expr("pmod(xxhash64(print, 2), blocks * 2)"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("spot", number, "print", "own")
    )
    return rest_side.union(all_side)


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of `docs` (doc_id, text; other columns are ignored).

    Fingerprints of `bits` or fewer differing bits are linked, and `component_id` is the least doc_id that links
    reach, the row's own included. Texts without words (null, empty, blanks) have fingerprint zero and are linked
    like any other. Rows with a null doc_id take part but are no candidate for the least one, so a component of
    such rows only is null; rows that repeat a doc_id are rows of their own. No documents give no rows. All
    results are the same for any `block` and `segments` (None: chosen by the number of fingerprints).
    """
    described = stage(fingerprints(docs, words), "prints")
    distinct = stage(described.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    ring = Ring.cut(bits, segments) if segments else Ring.for_count(bits, distinct.count())
    blocks = stage(_blocks(_members(distinct.select("print"), ring), block), "blocks")
    edges = stage(_edges(blocks, ring), "links")
    comps = components(edges)
    if not blocks.where("blocks > 1").isEmpty():
        more = _edges(stage(_across(blocks, stage(comps, "components"), block), "across"), ring)
        comps = components(stage(edges.union(more), "links"))
    least = stage(
        distinct.join(comps.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")),
        "classes",
    )
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = least.join(by_root, "root").select("print", "component_id")
    return described.join(by_print, "print", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
