import hashlib
import random
import sys
import zlib

import pytest

from tierline.llm.repair import lightest, repair, repaired, turn_edits

sys.setrecursionlimit(20_000)  # for `cheapest`
SCHEMA = "text string, cost int, conv_id long, turn long, role string"
BLANKS = " \t\n\x0b\x0c\r"
STEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) by trying everything, row by row; rows are (role, text, fault)."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in "a" else []
        for symbol in STEPS[state]:
            if symbol != "s" and inserted < 2:
                c, a, lines = best(i, symbol, inserted + 1)
                found.append((c + 5, "I" + a, ({"u": "user:", "a": "assistant:"}[symbol], *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, lines = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                for symbol in STEPS[state]:
                    if role[:1] == symbol:
                        c, a, lines = best(i + 1, symbol, 0)
                        found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    if symbol != "s":
                        c, a, lines = best(i + 1, symbol, 0)
                        name = {"u": "user", "a": "assistant"}[symbol]
                        found.append((c + more + 1, "R" + a, (f"{name}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        conv = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        if kind == 4:
            role = "user"
        conv += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = []
    for conv_id, conv in out.items():
        conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in conv:
            bare = text.rstrip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in conv if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        found.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def corpus(seed, convs=60, most=12):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "", "User", None, "tool"])
            text = rnd.choice(["Hi.", "no end", "é?", " \n", "", None, f"t{rnd.randrange(5)}!", "cut \x0b", "Z. "])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += rows[:20]
    rnd.shuffle(rows)
    return rows


def result(spark, rows, **how):
    df = spark.createDataFrame([(t, 1, c, n, r) for c, n, r, t in rows], SCHEMA)
    return sorted(map(tuple, repaired(df, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"chunk": 3}, {"chunk": 7, "most_bytes": 10}])
def test_equals_brute_force(spark, how):
    rows = corpus(len(how))
    assert result(spark, rows, **how) == brute(rows)


def test_long_conversation_in_chunks(spark):
    """One conversation holds most rows, and a third of them are the same row."""
    rnd = random.Random(5)
    rows = [(1, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", f"b{i}.", f"c{i}"])) for i in range(400)]
    rows += [(1, 5, "user", "again.")] * 300 + [(2, 0, "user", "x" * 100_000 + "."), (2, 1, "assistant", "y" * 100_000)]
    assert result(spark, rows, chunk=50) == brute(rows)


def test_no_rows(spark):
    assert result(spark, []) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(spark, [(dropped, 0, "user", "a.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_chunks_compose():
    """Two chunks put together by their weights give the repair of the whole."""
    rnd = random.Random(9)
    for _ in range(300):
        turns = [turn_edits(rnd.choice("sua-"), rnd.choice([None, None, "blank", "truncated"])) for _ in range(rnd.randint(2, 8))]
        cut = rnd.randint(1, len(turns) - 1)
        whole = []
        for q in range(4):
            after = lightest(turns[cut:], {0: (0, ""), 3: (0, "")}, range(4), True)
            for p, (cost, audit) in lightest(turns[:cut], {q: (0, "")}, [0], False).items():
                if q in after:
                    whole.append((cost + after[q][0], audit + after[q][1]))
        assert min(whole) == repair(turns)
