"""Sharding into contiguous parts of near equal size (law `bytes`), by minimax partition.

Rows that must stay together are one atomic group. Groups stand in the order of a 64-bit hash of their key.
The smallest feasible capacity is found by binary search, checking greedily, over the ordered group sizes.
The driver never sees all groups: it holds sums over intervals of the hash, finds the range of capacities
and cuts that these allow, and asks again for the few intervals in which a cut may fall, in at most `FINE`
finer ones, until every cut falls between two groups that it knows. The number of rows it holds does not
grow with the data, and each question is one aggregation.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import byte_count
from tierline.sources.sink import stage

#: Bits of the hash in the first summary, and the most intervals that a later one splits others into.
FIRST, FINE = 14, 1 << 16
#: Parts of a shard that are numbered on their own.
SLOT_PARTS = 1024
_SIGN = 1 << 63


@dataclass
class Interval:
    """Groups whose hash starts with the `bits` bits of `prefix`: their sizes' sum, the largest, the number."""

    bits: int
    prefix: int
    total: int
    largest: int
    groups: int

    @property
    def end(self) -> int:
        """First hash (as unsigned) after the interval."""
        return (self.prefix + 1) << (64 - self.bits)


class Line:
    """Intervals in order, with the sums up to their ends."""

    def __init__(self, intervals: Sequence[Interval]):
        self.parts = sorted(intervals, key=lambda x: x.end)
        self.ends, at = [0], 0
        for x in self.parts:
            at += x.total
            self.ends.append(at)
        self.total = at
        self.largest = max((x.largest for x in self.parts), default=0)

    def at(self, place: int) -> int:
        """Index of the interval that holds sum `place`; len(parts) at the very end."""
        return min(bisect_right(self.ends, place) - 1, len(self.parts))

    def surely(self, place: int) -> int:
        """A place not beyond the last group end at or before `place`."""
        i = self.at(place)
        if i == len(self.parts):
            return self.total
        return max(self.ends[i], place - self.parts[i].largest) if self.parts[i].groups > 1 else self.ends[i]

    def perhaps(self, place: int) -> int:
        """A place not before the last group end at or before `place`."""
        i = self.at(place)
        if i == len(self.parts):
            return self.total
        return place if self.parts[i].groups > 1 else self.ends[i]

    def fits(self, capacity: int, shards: int, step) -> bool:
        """Greedy check: does filling each shard as far as `step` tells use up all groups?"""
        place = 0
        for _ in range(shards):
            place = step(place + capacity)
        return place >= self.total

    def least(self, shards: int, step) -> int:
        low, high = max(self.largest, -(-self.total // shards)), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, step) else (middle + 1, high)
        return low

    def cuts(self, capacity: int, shards: int, down, up) -> list[int]:
        """Ends of the shards but the last. Each takes its even part of what is left, as far as capacity and
        the shards after it allow: the greedy check run from the right gives the least place for each cut."""
        floor = [self.total]
        for _ in range(shards - 1):
            floor.append(max(0, up(floor[-1] - capacity)))
        floor.reverse()  # floor[k]: shards k+1.. can take what comes after it
        place, out = 0, []
        for k in range(shards - 1):
            even = place + (self.total - place) // (shards - k)
            low, high = floor[k], place + capacity
            place = max(place, down(min(max(even, low), high)))
            out.append(place)
        return out


def _ceiling(line: Line, place: int) -> int:
    """First known end at or after `place`."""
    i = line.at(place)
    return line.ends[i] if i < len(line.ends) and line.ends[i] == place else line.ends[min(i + 1, len(line.parts))]


def _summary(groups: DataFrame, bits: int) -> list[Interval]:
    prefix = F.shiftrightunsigned(F.col("place"), 64 - bits)
    rows = (
        groups.groupBy(prefix.alias("prefix"))
        .agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.count("*").alias("groups"))
        .collect()
    )
    return [Interval(bits, r["prefix"] & ((1 << bits) - 1), r["total"], r["largest"], r["groups"]) for r in rows]


def _refine(groups: DataFrame, line: Line, at: set[int]) -> Line:
    """The line with the intervals `at` split further."""
    split = [line.parts[i] for i in at]
    step = max(1, (FINE // len(split)).bit_length() - 1)
    fresh: list[Interval] = []
    for bits in {x.bits for x in split}:
        chosen = [x.prefix for x in split if x.bits == bits]
        signed = [p - (1 << 64) if p >= _SIGN else p for p in chosen]
        part = groups.where(F.shiftrightunsigned(F.col("place"), 64 - bits).isin(signed))
        fresh += _summary(part, min(64, bits + step))
    return Line([x for i, x in enumerate(line.parts) if i not in at] + fresh)


def plan(groups: DataFrame, shards: int) -> list[int]:
    """Hashes (unsigned) before which each shard but the last ends. `groups`: place long, size long."""
    line = Line(_summary(groups, FIRST))
    while True:
        low, high = line.least(shards, line.perhaps), line.least(shards, line.surely)
        loose: set[int] = set()
        if low < high:  # the capacity is not known yet: look where a shard may end
            first = last = 0
            for _ in range(shards):
                first, last = line.surely(first + low), line.perhaps(last + high)
                loose |= {
                    i for i in range(line.at(first), min(line.at(last), len(line.parts) - 1) + 1)
                    if line.parts[i].groups > 1
                }
        else:  # cut: each place that the cuts ask for must be an end between two groups
            asked: list[int] = []

            def down(place: int) -> int:
                asked.append(place)
                return line.ends[min(line.at(place), len(line.parts))]

            def up(place: int) -> int:
                if place > 0:
                    asked.append(place)
                return _ceiling(line, max(0, place))

            places = line.cuts(high, shards, down, up)
            loose = {
                i for p in asked
                if (i := line.at(p)) < len(line.parts) and line.ends[i] != p and line.parts[i].groups > 1
            }
            if not loose:
                break
        line = _refine(groups, line, loose)
    ends = []
    for place in places:
        i = line.at(place)  # the interval that starts at the cut; empty intervals are not on the line
        ends.append(line.parts[i - 1].end if i else 0)
    return ends


def _signed(value: int) -> int:
    """Unsigned 64-bit hash to the signed one that has the same place once the sign bit is flipped."""
    return value - _SIGN


def shard_of(place: Column, ends: Sequence[int]) -> Column:
    """Shard of a hash: how many cuts are at or before it, compared as unsigned numbers."""
    flipped = place.bitwiseXOR(F.lit(-_SIGN))
    out = F.lit(0)
    for end in ends:
        out = out + (F.lit(False) if end >= 1 << 64 else flipped >= F.lit(_signed(end))).cast("int")
    return out.cast("int")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs` (doc_id, text).

    `size` is the UTF-8 bytes of the text plus 8. Equal texts are one atomic group (null is a text of its
    own), so a group that is larger than an even part fills a shard of its own and the others share the rest
    evenly. Slots count from 0 in each shard without a gap. Null and repeated doc_ids are rows like others;
    the crc32 of a null text is null. No documents give no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (byte_count(text) + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.xxhash64(text, text.isNull()), F.lit(0)).alias("place"),
    )
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    ends = plan(groups, shards)
    part = F.expr(f"cast(pmod(xxhash64(doc_id, place, size), {SLOT_PARTS}) as int)")
    placed = rows.select("*", shard_of(F.col("place"), ends).alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * SLOT_PARTS rows
    offsets = counts.select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "place"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
