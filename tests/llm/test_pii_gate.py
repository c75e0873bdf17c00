import random
import time

import pytest

from tierline.llm import pii


@pytest.mark.parametrize(
    "text,kind",
    [
        ("carte 4111\u00a01111\u00a01111\u00a01111 merci", "card"),
        ("tel +1\u00a0555\u00a0555\u00a00100 merci", "phone"),
        ("bob@exam\u00adple.com", "email"),
        ("bob@mıne.com", "email"),
        ("mail john at example.com today", "email"),
        ("ring +1 five 5 five 0 one 2 three 4 six now", "phone"),
    ],
)
def test_disguises_that_open_the_gate_alone(text, kind):
    base, every = pii.find(text)
    assert set(every[kind]) - set(base[kind])


def test_gate_changes_nothing(monkeypatch):
    rnd = random.Random(3)
    pieces = [
        "\u00a0", "\u00ad", "ı", "İ", " ", "\u200b", "＠", "²", "é", " at ", " dot ", " poİnt ", " AT ", "[at]", "( dot )", "@", ".", " ", " ", "-", ", ", "+1 ",
        "five", "Sechs", "fünf", "plus ", "5", "555", "one ", "two ", "4111 1111 1111 1111", "john", "example", ".com", "org", "1.2.3.4",
    ]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 16))) for _ in range(20000)]
    gated = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "suspicious", lambda text: True)
    assert [t for t, g in zip(texts, gated) if pii.find(t) != g] == []
    assert sum(base != every for base, every in gated) > 100


@pytest.mark.parametrize("n", [5_000, 1_000_000])
def test_parts_of_any_number_of_digits(n):
    zeros = "x " + "0" * n + ".1.1.1"
    assert pii.find(zeros)[0]["ip"] == [(2, len(zeros))]
    assert pii.find("x " + "9" * n + ".1.1.1")[0]["ip"] == []
    assert pii.find("0.0.0.0 256.1.1.1")[0]["ip"] == [(0, 7)]


@pytest.mark.parametrize("sign", ["\u00a0", "\u0430"])
def test_disguised_texts_take_linear_time(sign):
    start = time.monotonic()
    assert pii.find(sign + " " * 1_000_000 + "x (at) y [dot] com")[1]["email"] == [(1_000_001, 1_000_019)]
    addresses = sign + " " + "a@b.co, " * 100_000
    assert len(pii.find(addresses)[1]["email"]) == 100_000
    assert len(pii.find(sign + " " + "a (at) b (dot) co, " * 50_000)[1]["email"]) == 50_000
    assert time.monotonic() - start < 30


def test_brackets_one_after_another():
    text = "joe (at) (at) x  [dot] [dot] org"
    assert pii.signs(pii.fold(text)).text == "joe@@x..org"
