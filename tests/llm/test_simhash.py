import itertools
import random

import numpy as np
import pytest
import xxhash

from tierline.llm import simhash
from tierline.llm.simhash import Ring, simhash_components

SCHEMA = "text string, print string, doc_id long, component_id int"


def mark(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=4):
    marks = [mark(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{m:016x}", least.get(find(i))) for i, ((d, _), m) in enumerate(zip(rows, marks))), key=repr)


def result(spark, rows, **how):
    df = spark.createDataFrame([(t, "x", d, 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, simhash_components(df, **how).collect()), key=repr)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 60, 200]))] for _ in range(10)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            words[rnd.randrange(len(words))] = f"W{rnd.randrange(400)}"
        rows.append((i, rnd.choice([" ", "\n\t", "  "]).join(words)))
    extra = [None, "", " \n", "one", "One", "é \xa0 b", "É \xa0 b"]
    return rows + [(900 + i, t) for i, t in enumerate(extra)] + [(None, rows[0][1]), (None, "only here"), (7, "a a"), (7, "a a")]


@pytest.mark.parametrize("how", [{}, {"block": 6}, {"segments": 4}, {"segments": 3, "block": 8}, {"segments": 2, "bits": 2}])
def test_equals_all_pairs(spark, how):
    rows = corpus(len(how))
    assert result(spark, rows, **how) == brute(rows, how.get("bits", 4))


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_no_pair_is_lost(m):
    """Every difference of 4 bits or fewer has a chain from some segment; a larger one has none."""
    rnd = random.Random(m)
    ring = Ring.cut(4, m)
    assert sum(t for _, _, t in ring.segments) == 4 - m + 1
    near = [sum(1 << b for b in rnd.sample(range(64), n)) for n in range(5) for _ in range(300)]
    far = [sum(1 << b for b in rnd.sample(range(64), n)) for n in (5, 6, 9) for _ in range(300)]
    for xors, want in ((near, set(range(len(near)))), (far, set())):
        array = np.array(xors, np.uint64)
        assert {i for s in range(m) for i in simhash.viable(ring, s, array).tolist()} == want


def test_segments_follow_the_count():
    assert [len(Ring.for_count(4, n).segments) for n in (0, 10**6, 10**7, 10**8, 10**12)] == [5, 5, 4, 3, 2]


def test_long_text_and_no_documents(spark):
    rows = [(1, " ".join(f"w{i % 977}" for i in range(40000))), (2, "x" * 500000), (3, "X" * 500000)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_many_copies_in_blocks(spark):
    """A hub of near copies that is many blocks, and a chain that only leaves it at its edge."""
    rows = [(i, " ".join(f"t{j}" if j != i % 97 else f"v{i}" for j in range(100))) for i in range(300)]
    assert result(spark, rows, block=16) == brute(rows)
