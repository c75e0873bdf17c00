import random
import zlib
from collections import defaultdict

import pytest

from tierline.llm import sharding

SCHEMA = "text string, shard string, doc_id long, size string"


def least_capacity(sizes, shards):
    """By trying every capacity that a run of groups can have."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)} or {0})
    for c in sums:
        used, room = 1, c
        for s in sizes:
            if s > c:
                used = shards + 1
                break
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c


@pytest.mark.parametrize("seed,first", [(1, 14), (2, 3), (3, 1)])
def test_smallest_capacity(spark, seed, first, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", first)
    monkeypatch.setattr(sharding, "FINE", 8)
    rnd = random.Random(seed)
    texts = ["é" * rnd.randint(0, 300) + str(i % 40) for i in range(70)] + ["hot " * 50] * 20 + [None, None, "", ""]
    rows = [(t, "x", i if i % 9 else None, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard(df, 6).collect()
    assert len(out) == len(rows)
    by_shard, slots = defaultdict(int), defaultdict(list)
    for r in out:
        by_shard[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 6
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = [(len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for t in texts]
    assert sorted(((r["size"], r["text_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    from pyspark.sql import functions as F

    t = F.col("text")
    placed = df.groupBy(F.xxhash64(t, t.isNull()).alias("h")).agg(F.sum(F.coalesce(F.octet_length(t), F.lit(0)) + 8).alias("s"))
    ordered = [s for _, s in sorted(((r["h"] % (1 << 64)), r["s"]) for r in placed.collect())]
    assert max(by_shard.values()) == least_capacity(ordered, 6)


def test_equal_texts_stay_together(spark):
    texts = [str(i % 30) * 20 for i in range(300)]
    df = spark.createDataFrame([(t, "x", i, "y") for i, t in enumerate(texts)], SCHEMA)
    where = defaultdict(set)
    for r in sharding.shard(df).collect():
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_no_documents_and_one(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(sharding.shard(spark.createDataFrame([("a", "b", 1, "c")], SCHEMA)).collect()) == 1
