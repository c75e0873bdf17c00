"""Self-join of documents on the Jaccard similarity of their word n-grams, exact, with set-relation skipping.

Two documents link when |A n B| / |A u B| reaches the threshold. The result is the connected components.

* Any two linking sets share a token among the first `n - ceil(t * n) + 1` of each in a common order, and one
  more for each token that both prefixes are made longer by. Tokens are ordered by a frequency class, then by
  hash, so that passages common to many documents come last. A set with fewer shared tokens in its prefix
  than any partner must find there is left out, and the lists are drawn up anew without it.
* Index level: the lists of documents by token are joined into one group per least list member. Within a
  group a block of members is skipped if sizes or positions leave too little overlap: with the first common
  token at position p of a set of n, at most n - p tokens can be shared. Only sets that survive are fetched.
* Answer level: equal sets are one set. A large group is cut into blocks that all hold the group's leader;
  answers inside a block join its members to components. Sets joined to the same component as others need
  no further answers among them: the answers of one carry over to the rest. Only members left outside the
  group's main component are compared with the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bitmap, grouped, in_bitmap, shingle_sets, small_batches
from tierline.llm.components import components
from tierline.sources.sink import stage

#: Counters of the frequency sketch: 2**20, one byte each once they are classes.
SKETCH_BITS = 20
_SKETCH_BLOCK = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Link when `den * |A n B| >= num * |A u B|` over `words`-word shingles."""

    words: int = 5
    num: int = 80
    den: int = 100
    #: Part of a set, in hundredths, that its prefix is longer than one shared token needs.
    extra: int = 10
    #: Members of a block, and shingles in it.
    block_members: int = 1024
    block_shingles: int = 1 << 20

    def need(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of two sets with `total` members together."""
        return -(-self.num * total // (self.den + self.num))

    def prefix(self, n: int) -> int:
        return min(n, n + (-self.num * n // self.den) + 1 + n * self.extra // 100)

    def shared(self, n):
        """Tokens in the prefix of a set of `n` (a number or a column) that each partner's prefix holds too.
        The smallest partner has ceil(t * n) members."""
        least = (self.num * n + self.den - 1) / self.den
        if isinstance(n, int):
            return 1 + (self.num * n + self.den - 1) // self.den * self.extra // 100
        return 1 + F.floor(F.floor(least) * self.extra / 100)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _signature(s: np.ndarray) -> int:
    """Identity of a set: order-free, and mixed with the size."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(29)), dtype=np.uint64)
        return int(np.array([total * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))], np.uint64).view(np.int64)[0])


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


# Passes over the documents.


def _describe(rule: Rule):
    """Rows of documents (doc_id, n, sig), and per task the blocks of a count of shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        mask = np.uint64(counts.size - 1)
        for batch in batches:
            sizes, sigs, pending, held = [], [], [], 0
            for s in shingle_sets(_texts(batch), rule.words):
                sizes.append(len(s))
                sigs.append(_signature(s))
                pending.append(s & mask)
                held += len(s)
                if held > 1 << 20:
                    counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=counts.size)
                    pending, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=counts.size)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "n", "sig", "block", "counts"],
            )
        if counts.any():
            parts = counts.reshape(-1, _SKETCH_BLOCK)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "n", "sig", "block", "counts"],
            )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(raw, np.int64)
            total[block] = total[block] + part if block in total else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
        names=["block", "counts"],
    )


def _classes(described: DataFrame) -> np.ndarray:
    """Frequency class (binary logarithm) of each counter: a fixed number of bytes."""
    rows = (
        described.where("block is not null")
        .select("block", "counts")
        .repartition("block")
        .mapInArrow(_sum_blocks, "block int, counts binary")
        .collect()
    )
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in rows:
        counts[row["block"] * _SKETCH_BLOCK :][:_SKETCH_BLOCK] += np.frombuffer(bytes(row["counts"]), np.int64)
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


def _prefixes(rule: Rule, classes, tokens=None):
    """(token, sig, n, pos) for the prefix of each set; a set is given once per task. `tokens`: a bitmap that
    the token must be in; a set with too few such tokens is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, wanted = classes.value, tokens.value if tokens is not None else None
        mask = np.uint64(cls.size - 1)
        done: set[int] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingle_sets(_texts(batch), rule.words):
                n = len(s)
                sig = _signature(s)
                if not n or sig in done:
                    continue
                done.add(sig)
                # sorted by hash already, so a stable sort by class gives the order
                first = s[np.argsort(cls[(s & mask).astype(np.int64)], kind="stable")[: rule.prefix(n)]]
                at = np.arange(len(first))
                if wanted is not None:
                    keep = in_bitmap(wanted, first)
                    if keep.sum() < rule.shared(n):
                        continue
                    first, at = first[keep], at[keep]
                out[0].append(first)
                out[1].append(np.full(len(first), sig, np.int64))
                out[2].append(np.full(len(first), n, np.int64))
                out[3].append(at)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [_long(np.concatenate(x)) for x in out], names=["token", "sig", "n", "pos"]
                )

    return run


def _sets(rule: Rule, wanted):
    """(sig, members) of the sets that the bitmap `wanted` asks for, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        done: set[int] = set()
        for batch in batches:
            sigs, raws = [], []
            for s in shingle_sets(_texts(batch), rule.words):
                sig = _signature(s)
                if len(s) and sig not in done and in_bitmap(bits, np.array([sig]))[0]:
                    done.add(sig)
                    sigs.append(sig)
                    raws.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.int64()), pa.array(raws, pa.binary())], names=["sig", "members"]
            )

    return run


_POSTING = "token long, sig long, n long, pos long"


def _hubs(postings: DataFrame) -> DataFrame:
    """(token, hub): tokens that occur more than once, and the least set of their lists."""
    return (
        postings.groupBy("token")
        .agg(F.count("*").alias("c"), F.min("sig").alias("hub"))
        .where("c > 1")
        .select("token", "hub")
    )


def _enough(rule: Rule, postings: DataFrame) -> DataFrame:
    """The postings of sets that share as many tokens as a link needs. Copies of a row count once."""
    once = postings.select("token", "sig", "n", "pos").distinct()
    enough = once.groupBy("sig").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") >= rule.shared(F.col("n")))
    return once.join(enough.select("sig"), "sig", "left_semi")


# Work inside a block of a group.


def _possible(rule: Rule, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Members that sizes and positions allow to link with another member of the block. Members are taken in
    order of size, some rows at a time, against the later ones whose size is near enough."""
    order = np.argsort(n, kind="stable")
    n, left = n[order], (n - pos)[order]
    ok = np.zeros(len(n), bool)
    last = np.searchsorted(n, n * rule.den // rule.num, side="right")
    for a in range(0, len(n), 256):
        b = min(a + 256, len(n))
        end = int(last[b - 1])
        fits = np.minimum(left[a:b, None], left[None, a:end]) >= rule.need(n[a:b, None] + n[None, a:end])
        fits &= rule.den * n[a:b, None] >= rule.num * n[None, a:end]
        fits[np.arange(b - a), np.arange(b - a)] = False
        ok[a:b] |= fits.any(1)
        ok[a:end] |= fits.any(0)
    out = np.zeros(len(n), bool)
    out[order] = ok
    return out


def _skip(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["hub", "block"]):
            if group.num_rows < 2:
                continue
            if group["blocks"][0].as_py() > 1:  # partners may be in another block
                yield from group.combine_chunks().to_batches()
                continue
            keep = _possible(rule, group["n"].to_numpy(), group["pos"].to_numpy())
            if keep.any():
                yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of |A n B| for all pairs: rare tokens by their pairs, others by products of dense columns."""
    k = len(sets)
    out = np.zeros((k, k), np.int64)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    token = np.concatenate(sets) if k else np.zeros(0, np.uint64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    count = np.diff(np.append(start, len(token)))
    flat = out.reshape(-1)
    for c in range(2, 9):
        at = start[count == c]
        for i in range(c if len(at) else 0):
            for j in range(i + 1, c):
                flat += np.bincount(owner[at + i] * k + owner[at + j], minlength=k * k)
    often = np.flatnonzero(count > 8)
    for a in range(0, len(often), 2048):
        cols = often[a : a + 2048]
        size = count[cols]
        rows = np.concatenate([owner[start[c] : start[c] + count[c]] for c in cols])
        dense = np.zeros((k, len(cols)), np.float32)
        dense[rows, np.repeat(np.arange(len(cols)), size)] = 1
        out += np.triu((dense @ dense.T).astype(np.int64), 1)
    return out + np.triu(out, 1).T + np.tril(out, -1).T


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least index each index is connected with."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(rule: Rule):
    """Edges (a, b) that join the linked members of each block, as few as possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["hub", "block"]):
            if group.num_rows < 2:
                continue
            sigs = group["sig"].to_numpy()
            sets = [np.frombuffer(m.as_py(), np.uint64) for m in group["members"]]
            n = np.array([len(s) for s in sets])
            linked = overlaps(sets) >= rule.need(n[:, None] + n[None, :])
            root = _forest(linked)
            own = root != np.arange(len(root))
            if own.any():
                yield pa.RecordBatch.from_arrays([_long(sigs[own]), _long(sigs[root[own]])], names=["a", "b"])

    return run


def _edges(rule: Rule, jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges of all blocks (hub, block, sig). Sets are drawn from the texts again and go to their blocks."""
    spark = jobs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(jobs, "sig"))
    sets = texts.mapInArrow(_sets(rule, wanted), "sig long, members binary").dropDuplicates(["sig"])
    return (
        jobs.select("hub", "block", "sig")
        .distinct()
        .join(sets, "sig")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block")
        .mapInArrow(_link(rule), "a long, b long")
    )


def _blocks(rule: Rule, members: DataFrame) -> DataFrame:
    """Members with their block; the leader of a group of several blocks is in each of them."""
    large = (
        members.groupBy("hub")
        .agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        .where((F.col("k") > rule.block_members) | (F.col("total") > rule.block_shingles))
        .select(
            "hub",
            F.greatest(
                F.ceil(F.col("k") / rule.block_members), F.ceil(F.col("total") / rule.block_shingles)
            ).alias("blocks"),
        )
    )
    joined = members.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.expr("pmod(xxhash64(sig), blocks)"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return joined.withColumn("block", F.explode(F.when(F.col("sig") == F.col("hub"), every).otherwise(own)))


def _across(rule: Rule, blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Blocks that bring members outside the main component of a large group together with each block of the
    group: hub, block (the pair of blocks), sig."""
    many = blocks.where("blocks > 1").join(comps, blocks["sig"] == comps["node"], "left").select(
        "hub", "block", "blocks", "sig", F.coalesce("root", "sig").alias("comp")
    )
    main = (
        many.groupBy("hub", "comp")
        .agg(F.count("*").alias("c"))
        .groupBy("hub")
        .agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    )
    rest = many.join(main, "hub").where("comp <> main").select("hub", "sig", "block", "blocks")
    of_rest = rest.groupBy("hub").agg(F.countDistinct("sig").alias("left_out"))
    halves = F.greatest(F.lit(1), F.ceil(F.col("left_out") * 2 / rule.block_members)).cast("long")
    # rest in r parts, each with half a block of the group at a time
    parts = of_rest.select("hub", halves.alias("parts"))
    rest_side = (
        rest.select("hub", "sig", "blocks").distinct().join(parts, "hub")
        .withColumn("part", F.expr("pmod(xxhash64(sig, 1), parts)"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") * 2 - 1)))
        .select("hub", F.expr("part * blocks * 2 + slice").alias("block"), "sig")
    )
    all_side = (
        many.select("hub", "sig", "blocks").distinct().join(parts, "hub")
        .withColumn("slice", F.expr("pmod(xxhash64(sig, 2), blocks * 2)"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("hub", F.expr("part * blocks * 2 + slice").alias("block"), "sig")
    )
    return rest_side.union(all_side)


def ngram_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text; other columns are ignored).

    `component_id` is the least doc_id that links reach, the row's own included. Null and empty texts, and
    texts of blanks only, have no shingles, link with nothing and keep their own doc_id. Rows with a null
    doc_id take part; they count as no candidate for the least one, so a component of such rows only is null.
    Rows that repeat a doc_id are rows of their own. No documents give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("text")
    described = stage(
        docs.mapInArrow(_describe(rule), "doc_id long, n long, sig long, block int, counts binary"), "described"
    )
    classes = spark.sparkContext.broadcast(_classes(described))  # 2**SKETCH_BITS bytes
    hubs = stage(_hubs(texts.mapInArrow(_prefixes(rule, classes), _POSTING)), "hubs")
    shared = spark.sparkContext.broadcast(bitmap(hubs, "token"))
    postings = texts.mapInArrow(_prefixes(rule, classes, shared), _POSTING).join(hubs, "token", "left_semi")
    postings = stage(_enough(rule, stage(postings, "postings")), "postings")
    postings = postings.join(_hubs(postings), "token")
    members = postings.groupBy("hub", "sig").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    blocks = stage(_blocks(rule, stage(members, "members")), "blocks")
    jobs = stage(
        blocks.select("hub", "block", "blocks", "sig", "n", "pos")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block")
        .mapInArrow(_skip(rule), "hub long, block long, blocks long, sig long, n long, pos long"),
        "jobs",
    )
    edges = stage(_edges(rule, jobs, texts), "links")
    comps = components(edges)
    if not blocks.where("blocks > 1").isEmpty():
        comps = stage(comps, "components")
        more = _edges(rule, stage(_across(rule, blocks, comps), "across"), texts)
        comps = components(stage(edges.union(more), "links"))
    described = described.where("block is null").select("doc_id", "n", "sig")
    least = (
        described.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
        .join(comps.withColumnRenamed("node", "sig"), "sig", "left")
        .withColumn("root", F.coalesce("root", "sig"))
    )
    least = stage(least, "classes")
    by_root = least.groupBy("root").agg(F.min("least").alias("component"))
    by_sig = least.join(by_root, "root").select("sig", "component")
    return described.join(by_sig, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
