import zlib

import pytest

from tierline.llm import toxicity
from tierline.llm.common import table

SCHEMA = "text string, score string, doc_id long, predicted int, toxic int"


@pytest.mark.parametrize("sf,least", [("0.1", 0.97)])
def test_held_out_accuracy(spark, sf, least):
    docs, labels = (table(spark, f"/root/testdata/sf{sf}", n) for n in ("documents", "labels"))
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d]["held_out"] for d in test) and all(0 <= r["score"] <= 1 for r in out.values())
    right = sum(out[d]["predicted"] == want[d] for d in test) / len(test)
    missed = [d for d in test if want[d] and not out[d]["predicted"]]
    wrong = [d for d in test if not want[d] and out[d]["predicted"]]
    print(right, len(missed), len(wrong), sum(want[d] for d in test), len(test))
    assert right >= least and len(wrong) <= 0.01 * len(test)


def test_features():
    lexicon = toxicity.lexica(["you idiot", "an idiot", "IDIOT!!", "idi0t x", "fine", "good day", "good", "so", "it", "is"], [1, 1, 1, 1] + [0] * 6)
    assert len(lexicon[0][0]) == 1
    rows = toxicity.dense(["you idi0t", "", None, "a you b c d e f g idiot", "OK", "x" * 300000], lexicon)
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    assert rows[0][at["count_word"]] == 1 and rows[0][at["near_share"]] == 1 and rows[0][at["obfuscated_hits"]] == 1
    assert not rows[1].any() and not rows[2].any()
    assert rows[3][at["count_word"]] == 1 and rows[3][at["near_share"]] == 0
    assert rows[4][at["capitals"]] == 1


def test_rows_and_one_kind(spark):
    df = spark.createDataFrame([("a b", "s", 1, 0, 0), (None, "s", 2, 0, 0), ("", "s", None, 0, 0), ("a b", "s", 1, 0, 0)], SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, toxicity.toxicity(df, none).select("doc_id", "score", "predicted").collect()), key=repr)
    assert got == sorted([(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0), (1, 0.0, 0)], key=repr)
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(df, some).collect()) == 4
    assert toxicity.toxicity(df.limit(0), none).collect() == []
