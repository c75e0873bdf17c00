import hashlib
import random
import re

import pytest

from tierline.llm import pii

#: The plain patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def given(text):
    out = {}
    for kind, pattern in GIVEN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_plain_patterns_on_random_texts():
    rnd = random.Random(1)
    pieces = ["a", "b.c", "@", ".", "-", "+1", "9", "255", "4111 1111 1111 1111", "4111111111111111", " ", "é", "x@y.de", "1.2.3.4", "(555) 0100", "\n", "%", "00012"]
    for _ in range(20000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.plain_spans(text) == given(text), text


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("write to bob [at] mail8 [dot] example [dot] com today", "email", "bob [at] mail8 [dot] example [dot] com"),
        ("mail ann.lee at host dot example dot org, please", "email", "ann.lee at host dot example dot org"),
        ("mail bоb@exаmple.com now", "email", "bоb@exаmple.com"),
        ("im bob＠example．com", "email", "bob＠example．com"),
        ("call +１ (555) 555-0100 x", "phone", "+１ (555) 555-0100"),
        ("ring plus one five five five five five five zero one zero zero please", "phone", "plus one five five five five five five zero one zero zero"),
        ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
        ("host 10[.]0[.]0[.]1 is up", "ip", "10[.]0[.]0[.]1"),
        ("bob@exam​ple.com", "email", "bob@exam​ple.com"),
    ],
)
def test_disguises(text, kind, part):
    base, every = pii.find(text)
    assert part in [text[a:b] for a, b in every[kind]] or any(a <= text.find(part) and b >= text.find(part) + len(part) for a, b in every[kind]), every
    assert all(set(base[k]) <= set(every[k]) for k in base)


@pytest.mark.parametrize("text", ["he is at the dot of noon", "one two three", "we met at noon. dot com boom", "Что это", "one, two, three, four and five", "a (at) b"])
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 200_000, "1 " * 200_000, "." * 200_000, "one " * 60_000, "a@" * 100_000, "+1" * 100_000, "[" * 100_000, "1." * 100_000):
        pii.find(text)


def test_rows(spark):
    df = spark.createDataFrame([("x a@b.cd 1.2.3.4", 5, 1), (None, 5, 2), ("", 5, 3), ("é +1 (555) 555-0100", 5, None), ("", 5, 3)], "text string, spans int, doc_id long")
    got = {(r["doc_id"], r["spans"]): r for r in pii.personal_data(df).collect()}
    assert set(got) == {(1, "email:2:8,ip:9:16"), (2, ""), (3, ""), (None, "phone:2:19")}
    assert got[(2, "")]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[(1, "email:2:8,ip:9:16")]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert pii.personal_data(df.limit(0)).collect() == []
