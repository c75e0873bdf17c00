from tierline.llm import decontamination as dc

DOC = "text string, doc_id long"
ITEM = "text string, item_id long"
FILLER = "we saw that they have the old apples and that it is how many of them have to go"
TRAIN = "A train leaves the old station at 7:30 and travels 120 km towards the coast, where Maria waits with 3 bags for Maria and her friend until the train from the north arrives after 45 minutes of delay"
SALES = "Tom has 5 apples. Mary has 3 apples. How many apples do they have together if Tom eats 2 of them and Mary buys 4 more at the market for her friend"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(zip(texts, range(len(texts)))), DOC)
    bench = spark.createDataFrame(list(zip(items, range(len(items)))), ITEM)
    return {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()}


def test_case_spacing_and_place_do_not_hide_a_copy(spark):
    other = SALES.replace("Tom", "Steve").replace("Mary", "Julia").replace("5", "7").replace("3", "9")
    texts = [
        TRAIN.upper(), TRAIN.lower(), TRAIN.replace(" ", "  "), TRAIN.replace(" ", "\n"), TRAIN.replace(" ", "\u00a0"),
        other, other.upper(), "nothing to see here " * 10,
    ]
    got = found(spark, texts, [TRAIN, SALES, FILLER])
    assert got == {(i, 0) for i in range(5)} | {(5, 1), (6, 1)}


def test_short_questions_and_one_changed_word(spark):
    words = "we ask how far the small boat could go along that wide river before its crew must turn back for more bread and some clean water".split()
    items = ["what is 12 + 7 * 3", "who wrote it", "17 + 4", "Tom has 5 apples now", *(" ".join(words[:n]) for n in range(8, 25))]
    texts = [f"Before. {t} after it" for t in items]
    want = {(i, i) for i in range(4)}
    for n in range(8, 25):
        for at in range(n):
            want.add((len(texts), n - 4))
            texts.append("Before. " + " ".join([*words[:at], "changed", *words[at + 1 : n]]) + " after it")
    texts += ["what is 12 + 7 * 4", "what is 12 + 7 - 3", "who wrote that", "17 - 4", "Bob has 6 apples now", "it is a small boat and a wide river, and some water"]
    got = found(spark, texts, items)
    assert want <= got
    assert not any(d >= len(texts) - 6 for d, _ in got)
