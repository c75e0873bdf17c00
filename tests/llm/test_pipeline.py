import itertools
import random
from collections import defaultdict

import corpus_pipeline as cp
from test_decontamination import QUESTION
from tierline.llm.common import table
from tierline.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, n_chars long, doc_id long, lang string, source string, size int"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(5, 80))]
        for j in range(rnd.randint(1, 3)):
            if j and rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = "changed"
            rows.append((" ".join(w), 1, len(rows), "en", "s", 0))
    rows += [(None, 0, 900, None, None, 0), ("", 0, 901, "en", "s", 0), ("a b", 3, None, "en", "s", 0), ("a b", 3, 902, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = [(r[2], shingles(r[0])) for r in rows if r[2] is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    kept = cp.drop_near_duplicates(spark, df, SF)
    assert kept.columns == cp.COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in sets if find(d) == d)


def test_repeated_and_shared_ids(spark):
    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(same, 1, 7, "en", "s", 0), (same, 1, 7, "en", "s", 0), (same, 1, None, "en", "s", 0), (other, 1, 7, "en", "s", 0)]
    rows += [(other, 1, None, "en", "s", 0), ("alone without an id", 1, None, "en", "s", 0), ("alone without an id", 1, None, "en", "s", 0)]
    rows += [(None, 1, 8, None, None, 0), (None, 1, 8, None, None, 0)]
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    want = [(7, same), (7, other), (None, "alone without an id"), (8, None), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(want, key=repr)


def test_toxic_rows_go_by_their_text(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    bad, good = (judged.where(f"held_out and predicted = {p}").orderBy("doc_id").first() for p in (1, 0))
    extra = [(bad["text"], 1, None, "en", "s"), (bad["text"], 1, good["doc_id"], "en", "s"), (good["text"], 1, None, "en", "s")]
    extra = spark.createDataFrame(extra, "text string, n_chars long, doc_id long, lang string, source string")
    kept = cp.drop_toxic(spark, docs.select(cp.COLUMNS).unionByName(extra.selectExpr(*(f"cast({c} as {t}) {c}" for c, t in docs.select(cp.COLUMNS).dtypes))), sf)
    found = {(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()}
    assert (good["doc_id"], good["text"]) in found and (None, good["text"]) in found
    assert not {t for _, t in found} & {bad["text"]}


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    toxic = {r["doc_id"] for r in toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    now = docs.cache()
    ids = []
    for _, apply in cp.STAGES[:-1]:
        now = apply(spark, now, SF).cache()
        assert now.columns == cp.COLUMNS
        ids.append([r["doc_id"] for r in now.select("doc_id").collect()])
    assert set(ids[0]) == {r["doc_id"] for r in docs.collect()} - toxic
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2])
    assert max(ids[3].count(i) for i in set(ids[3])) <= 2
    out = cp.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids[3])
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_contaminated_go(spark, tmp_path):
    spark.createDataFrame([(0, QUESTION)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([("x " + QUESTION + " y", 1, 1, "en", "s", 0), ("fine", 1, 2, "en", "s", 0)], SCHEMA)
    kept = cp.drop_contaminated(spark, df, str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == cp.COLUMNS


def test_no_documents(spark):
    now = spark.createDataFrame([], SCHEMA)
    for _, apply in cp.STAGES:
        now = apply(spark, now, SF)
    assert now.collect() == []
