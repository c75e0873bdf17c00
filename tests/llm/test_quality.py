import random
import re
import zlib
from collections import Counter

from tierline.llm import quality
from tierline.llm.common import table

SCHEMA = "text string, quality string, doc_id long, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


def test_base_counts():
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n", "a b c", "é 漢字 #", "x " * 100000, "y" * 100000]
    texts += ["".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "a b c\n", "\x0b", "\r\n"]) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    assert [tuple(r) for r in quality.base_counts(texts).tolist()] == [brute(t) for t in texts]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    right = sum((out[d]["probability"] >= quality.LEAST_PROBABILITY) == want[d] for d in test)
    assert right / len(test) > 0.95
    good = [d for d in test if want[d] and not out[d]["base_failed"]]
    assert sum(out[d]["kept"] for d in good) / len(good) > 0.97


def test_rows_and_no_labels(spark):
    df = spark.createDataFrame([("w " * 10, "q", 1, 0), (None, "q", 2, 0), ("", "q", None, 0), (" ".join(f"w{i}" for i in range(60)), "q", 2, 0)], SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality.quality(df, none).collect())
    assert got == [(0, 0, False), (1, 10, False), (2, 0, False), (2, 60, True)]
    assert quality.quality(df.limit(0), none).collect() == []
