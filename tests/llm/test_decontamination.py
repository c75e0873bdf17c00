import random
import re

from tierline.llm import decontamination as dc

SCHEMA = "text string, item_id string, doc_id long, hash string, pos int"
BENCH = "text string, words int, item_id long, hash int"

QUESTION = "A train leaves the old station at 7:30 and travels 120 km towards the coast, where Maria waits with 3 bags for Maria and her friend until the train from the north arrives after 45 minutes of delay"


def docs(spark, texts):
    return spark.createDataFrame([(t, "x", i, "y", 0) for i, t in enumerate(texts)], SCHEMA)


def bench(spark, texts):
    return spark.createDataFrame([(t, 0, i, 0) for i, t in enumerate(texts)], BENCH)


def brute(doc_texts, bench_texts, k=8, literal=5, share=40, enough=24):
    """By comparing every window of every document with every window of every question, on word lists made by
    a tokeniser of its own: words that begin with a digit are numbers, capitalised ones that follow a word and
    one blank are names."""

    def tokens(text):
        out = []
        for m in re.finditer(r"\S+", text or ""):
            w = m.group()
            bare = "".join(c for c in w if c.isalnum())
            if not bare:
                continue
            if w[0].isdigit():
                out.append(("#", bare.lower()))
            elif w[0].isupper() and m.start() > 1 and text[m.start() - 1] == " " and (text[m.start() - 2].isalnum() or text[m.start() - 2] in ",;:)"):
                out.append(("@", bare.lower()))
            else:
                out.append((bare.lower(), None))
        return out

    found = set()
    B = [tokens(t) for t in bench_texts]
    for d, text in enumerate(doc_texts):
        D = tokens(text)
        for q, Q in enumerate(B):
            every = [i for i in range(len(Q) - k + 1) if sum(v is None for _, v in Q[i : i + k]) >= literal]
            shifts = {}
            for i in every:
                for j in range(len(D) - k + 1):
                    if [a for a, _ in Q[i : i + k]] == [a for a, _ in D[j : j + k]]:
                        shifts.setdefault(j - i, set()).add(i)
            held = set()
            for shift, at in shifts.items():
                pairs = {(Q[i + x][1], D[i + x + shift][1]) for i in at for x in range(k) if Q[i + x][1] is not None}
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    held |= at
            if held and (100 * len(held) >= share * len(every) or len(held) >= enough):
                found.add((d, q, len(held)))
    return found


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "cat", "of", "sat", "run", "blue", "Anna", "Bob", "12", "7", "on,", "mat.", "tree"])
    items = [" ".join(word() for _ in range(rnd.randint(5, 30))) for _ in range(12)]
    texts = [None, "", "x"]
    for _ in range(60):
        w = [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            q = rnd.choice(items).split()
            a = rnd.randint(0, len(q) // 2)
            q = [{"12": "99", "7": "5", "Anna": "Carl"}.get(x, x) if rnd.random() < 0.9 else x for x in q[a:]]
            at = rnd.randint(0, len(w))
            w[at:at] = q
        texts.append(rnd.choice([" ", " ", "\n"]).join(w))
    got = {(r["doc_id"], r["item_id"], r["n_windows"]) for r in dc.matches(docs(spark, texts), bench(spark, items)).collect()}
    assert got == brute(texts, items) and len(got) > 5


def test_reparameterised_and_inconsistent(spark):
    other = QUESTION.replace("7:30", "9:15").replace("120 km", "80 miles").replace("Maria", "Peter").replace("3 bags", "5 bags").replace("45 minutes", "20 minutes")
    broken = other.replace("for Peter", "for Susan")
    cased = "Before. " + QUESTION.upper() + " after"
    texts = [QUESTION, "Some text. " + other + " More text.", broken, "nothing to see here " * 10, "Before it\n" + QUESTION + "\nafter", QUESTION.replace(" ", "  ")]
    got = {r["doc_id"]: r for r in dc.matches(docs(spark, texts + [cased]), bench(spark, [QUESTION, None, "", "too short"])).collect()}
    assert {0, 1, 4} <= set(got) and 3 not in got
    assert 2 not in got or got[2]["n_windows"] < got[1]["n_windows"]
    assert got[1]["n_slots"] >= 4


def test_clean_keeps_the_rest(spark):
    df = docs(spark, [QUESTION, "fine text", None, "", "w " * 100000])
    more = df.union(spark.createDataFrame([(QUESTION, "x", None, "y", 0), ("fine", "x", None, "y", 0), ("fine", "x", 0, "y", 0)], SCHEMA))
    kept = dc.clean(more, bench(spark, [QUESTION]))
    assert kept.columns == more.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect() if len(r["text"] or "") < 99), key=repr) == sorted([(1, "fine text"), (2, None), (3, ""), (None, "fine"), (0, "fine")], key=repr)
    assert dc.matches(df.limit(0), bench(spark, [QUESTION])).collect() == []
    assert dc.matches(df, bench(spark, []).limit(0)).collect() == []
