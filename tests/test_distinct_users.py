import datetime as dt

import pytest

from callscape.operators import distinct_users as D
from callscape.operators import presence as B

from helpers import call, calls, random_calls, rows, sites
from test_presence import labels


def states(spark, data, grain="hour", known=None):
    cdr, cells = calls(spark, data), sites(spark)
    numbers = D.number_users(B.presence_users(cdr, cells), known)
    return D.presence_states(cdr, cells, labels(spark), numbers, grain), numbers


DATA = random_calls(900) + [call(None, "00001_x", dt.datetime(2015, 1, 3, 4, 5))] * 3


def test_hours_merge_to_days(spark):
    found, numbers = states(spark, DATA)
    got = D.presence_from_states(found, "day")
    assert rows(got) == rows(B.presence(calls(spark, DATA), sites(spark), labels(spark), "day"))
    assert sorted(n for _, n in rows(numbers)) == list(range(1, numbers.count() + 1))


def test_regions_and_classes_merge(spark):
    found, _ = states(spark, DATA, None)
    by_day = {}
    for user, _, date in rows(B.presence_users(calls(spark, DATA), sites(spark), "day")):
        by_day.setdefault(date, set()).add(user)
    got = D.presence_from_states(found, "day", ("date",))
    assert rows(got) == sorted(((d, len(u)) for d, u in by_day.items()), key=repr)


def test_many_blocks(spark):
    data = [call(f"v{i}", "00000_x", dt.datetime(2015, 1, 1)) for i in range(10)]
    cdr, cells = calls(spark, data), sites(spark)
    far = spark.createDataFrame([(f"v{i}", i * 32768 + 1 + i % 2) for i in range(10)],
                                "user_id string, user_no long")
    found = D.presence_states(cdr, cells, labels(spark), far)
    assert found.count() == 10
    assert D.presence_from_states(found, "day", ("date",)).first()["n_users"] == 10


def test_numbers_stay_when_users_are_added(spark):
    half = DATA[: len(DATA) // 30]
    _, first = states(spark, half)
    _, both = states(spark, DATA, known=first)
    old, new = dict(rows(first)), dict(rows(both))
    assert old.items() <= new.items() and len(new) > len(old)
    assert sorted(new.values()) == list(range(1, len(new) + 1))
    assert len(rows(both)) == len(new)


def test_unknown_user_fails(spark):
    _, numbers = states(spark, DATA)
    found = D.presence_states(calls(spark, [call("new", "00001_x", dt.datetime(2015, 1, 3))]),
                              sites(spark), labels(spark), numbers)
    with pytest.raises(Exception, match="a user has no number"):
        found.collect()


def test_no_calls(spark):
    found, numbers = states(spark, [])
    assert rows(numbers) == [] and rows(D.presence_from_states(found, "day")) == []
