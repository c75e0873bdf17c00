"""Events led by the last mark before them, against brute force."""

import datetime as dt
import random

from tierline.operators import ordered as O

DAY = dt.date(2001, 1, 1)


def brute(events, marks):
    out = []
    for key, day, name in events:
        before = [m for k, m in marks if k == key and m is not None and day is not None and m <= day]
        out.append((key, day, name, max(before, default=None)))
    return sorted(out, key=repr)


def run(spark, events, marks):
    left = spark.createDataFrame(events, "k string, sold date, _name string")
    right = spark.createDataFrame(marks, "k string, asked date")
    return sorted(map(tuple, O.asof_last(left, right, ["k"], "sold", "asked", "led_by").collect()), key=repr)


def test_equals_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    day = lambda: rnd.choice([None, *[DAY + dt.timedelta(rnd.randrange(40))] * 9])
    events = [(key(), day(), f"e{i}") for i in range(500)]
    marks = [(key(), day()) for _ in range(60)]
    assert run(spark, events, marks) == brute(events, marks)


def test_mark_of_the_same_day_leads(spark):
    events = [("a", DAY, "x"), ("a", DAY - dt.timedelta(1), "y"), ("b", DAY, "z"), ("a", DAY, "x")]
    assert run(spark, events, [("a", DAY)]) == brute(events, [("a", DAY)])
    assert [r[3] for r in run(spark, events, [("a", DAY)])].count(None) == 2


def test_no_marks_or_events(spark):
    events = [("a", DAY, "x")]
    assert run(spark, events, []) == brute(events, [])
    assert run(spark, [], [("a", DAY)]) == []
