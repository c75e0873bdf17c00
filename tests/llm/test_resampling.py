import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tierline.llm.resampling import Features, Scanner, combine, ngram_crcs, resample

SCHEMA = "text string, rank string, doc_id long, score int"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text, kind):
    w = plain_words(text)
    grams = [" ".join(w[i : i + n]) for n in range(kind.least, kind.most + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % kind.buckets for g in grams]


def brute(rows, target, kind, percent=10, least=20):
    m = kind.buckets
    s, t = [0] * m, [0] * m
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in plain_buckets(text, kind):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + m) / ((s[b] + 1) * (sum(t) + m)))) for b in range(m)]
    out = []
    for doc_id, text in rows:
        b = plain_buckets(text, kind)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append([doc_id, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, text) in zip(out, rows) if len(plain_words(text)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"{'éxÉ'[i % 3]}{rnd.choice('abc')}{i}" for i in range(300)] + ["Hot"] * 40
    text = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(rnd.choice([3, 19, 20, 60])))
    rows = [(i, text()) for i in range(200)]
    rows += [(900, None), (901, ""), (902, " ,\n"), (None, rows[5][1]), (None, rows[5][1]), (7, rows[7][1]), (7, "w " * 30)]
    return rows, [text() for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("kind", [Features(1, 1, 10_000), Features(1, 3, 257), Features(2, 2, 64)])
def test_equals_brute_force(spark, kind):
    rows, target = corpus(kind.most)
    docs = spark.createDataFrame([(t, "r", d, 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, bench, kind, percent=25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, kind, 25)


@pytest.mark.parametrize("known", [[], ["a"], ["a", "b b"[:1], "é", "abc"]])
def test_words_outside_the_dictionary(known):
    """Whatever the dictionary holds, payloads are those of all words in order."""
    scanner = Scanner(known)
    for text in ["", "a", "a a a", "abc abcd  a-É.zz a", "x" * 5000, "é é_a\x7fb", None]:
        crc, length = scanner.payloads(text)
        raws = [w.encode() for w in plain_words(text)]
        assert crc.tolist() == [zlib.crc32(r) for r in raws] and length.tolist() == [len(r) for r in raws]


def test_composed_crcs():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"abcz") for _ in range(rnd.choice([1, 2, 7, 300]))) for _ in range(40)]
    crc, length = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    assert combine(crc[:-1], crc[1:], length[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]
    want = [zlib.crc32(b" ".join(words[i : i + n])) for n in (2, 3, 4) for i in range(len(words) - n + 1)]
    assert ngram_crcs(crc, length, 2, 4).tolist() == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample(none, none).collect() == []
    long = [(1, "word " * 60_000), (2, "y" * 300_000)]
    docs = spark.createDataFrame([(t, "r", d, 1) for d, t in long], SCHEMA)
    assert sorted(map(tuple, resample(docs, none, percent=100).collect()), key=repr) == brute(long, [], Features(), 100)
