import itertools
import random

import pytest

from tierline.llm.ngram_join import Rule, ngram_components

SCHEMA = "text string, source string, doc_id long, n_shingles int"


def brute(rows, words, num, den):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(
        ((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rnd.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.3:
            w += passage
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (None, base[0][0]), (None, "only here"), (7, "x y"), (7, "x y"), (503, "É é"), (504, "é é")]


def result(spark, rows, rule):
    df = spark.createDataFrame([(t, "s", d, 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, ngram_components(df, rule).collect()), key=repr)


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule(5, 80, 100, block_members=8), Rule(2, 60, 100, block_members=5)])
def test_equals_all_pairs(spark, rule):
    rows = corpus(rule.words)
    assert result(spark, rows, rule) == brute(rows, rule.words, rule.num, rule.den)


def test_no_documents(spark):
    assert result(spark, [], Rule()) == []


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 300000)]
    assert result(spark, rows, Rule(4, 85, 100)) == brute(rows, 4, 85, 100)
