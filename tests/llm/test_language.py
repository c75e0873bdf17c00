import random
import zlib

import numpy as np

from tierline.llm import language
from tierline.llm.common import table

SCHEMA = "text string, lang string, doc_id long, score string, held_out int"


def brute_phrases(text, corpus):
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in corpus:
            n += 1
        count += 1
        i += n
    return count


def test_phrases_equal_search_by_hand():
    rnd = random.Random(2)
    for _ in range(30):
        corpus = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60)))
        texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 40))) for _ in range(8)]
        codes = [np.array([ord(c) - 96 for c in t], np.uint8) for t in sorted(texts, key=len, reverse=True)]
        table_ = language.automaton([ord(c) - 96 for c in corpus], 6)
        pieces = np.zeros((max(map(len, codes)), len(codes)), np.uint8)
        for k, c in enumerate(codes):
            pieces[: len(c), k] = c
        got = language.phrases(pieces, np.array([len(c) for c in codes]), table_)
        assert got.tolist() == [brute_phrases(t, corpus) for t in sorted(texts, key=len, reverse=True)]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = language.languages(docs).collect()
    assert len(out) == len(want)
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in test) / len(test) > 0.97


def test_rows(spark):
    data = [("the cat and the dog " * 20, "en", i, "s", 0) for i in range(1, 9)] + [("der hund und die katze " * 20, "de", i, "s", 0) for i in range(9, 20)]
    data += [(None, "en", 30, "s", 0), ("", "en", 31, "s", 0), ("12 ,;", None, 32, "s", 0), ("und die katze", None, None, "s", 0), ("the dog", None, 33, "s", 0), ("Ω" * 2000, None, 34, "s", 0), ("the dog " * 40000, None, 35, "s", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(df).collect()}
    assert {k: got[k] for k in (30, 31, 32, None, 33, 35)} == {30: "und", 31: "und", 32: "und", None: "de", 33: "en", 35: "en"}
    assert language.languages(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.languages(df.withColumn("lang", df["lang"].substr(9, 1)).where("doc_id < 3").drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_scripts_keep_their_letters(spark):
    """Three languages of one script of many letters each, next to a Latin one: no alphabet crowds out another."""
    rnd = random.Random(4)
    first = {"aa": 0x4E00, "bb": 0x5000, "cc": 0x3B1, "dd": 0x61}
    words = {k: ["".join(chr(a + rnd.randrange(240 if a > 0x4000 else 24)) for _ in range(4)) for _ in range(60)] for k, a in first.items()}
    rows = [(" ".join(rnd.choices(words[k], k=80)), k, i * 4 + j, "s", 0) for i in range(30) for j, k in enumerate(first)]
    out = language.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in out} == {(i, k) for _, k, i, _, _ in rows}


def test_training_texts_are_bounded_and_from_whole_texts(spark):
    """One id with very many equal rows brings one piece; pieces do not all stand at the head of their texts."""
    same = [("the cat " * 5, "en", 1, "s", 0)] * 10000
    long = [("a" * 50000 + "b" * 50000, "en", i, "s", 0) for i in range(2, 40)]
    got = language.training_texts(spark.createDataFrame(same + long, SCHEMA))["en"]
    assert got.count("the cat " * 5) == 1 and len(got) <= language.DOCS_PER_LANGUAGE
    assert max(map(len, got)) == language.CHARACTERS_PER_DOC
    assert any("b" in t for t in got) and any("a" in t for t in got)


def test_a_language_without_letters(spark):
    rows = [("12 34 56", "nn", i, "s", 0) for i in range(9)] + [("the cat and the dog", "en", i, "s", 0) for i in range(9, 30)]
    out = language.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] >= 9} == {"en"} and {r["lang_pred"] for r in out if r["doc_id"] < 9} == {"und"}
