import datetime as dt
from collections import defaultdict

import pytest

from callscape.functions.calendar import MONDAY_SUNDAY, SATURDAY_SUNDAY
from callscape.operators import windows as W
from callscape.operators.profile import (
    calling_activity,
    merge_weeks,
    profile_vectors,
    user_profile,
    user_profile_sql,
    weekly_states,
)

from helpers import REGION_OF, calls, plan, random_calls, rows, sites

START, END = "2014-12-22", "2015-01-29"


def expected_entries(data, size, weekend):
    first = dt.date.fromisoformat(START)
    n_total = (dt.date.fromisoformat(END) - first).days // 7 + 1
    days = defaultdict(set)
    for user, cell, when, clock, *_ in data:
        region = REGION_OF.get(cell[:5])
        pos = (when.date() - first).days // 7
        if region is None or not 0 <= pos < n_total:
            continue
        begin = first + dt.timedelta(weeks=pos // size * size)
        hour = int(clock[:2])
        slot = 0 if hour <= 8 else 1 if hour <= 18 else 2
        is_we = int(when.isoweekday() in weekend)
        key = (*begin.isocalendar()[:2], region, user, pos % size, is_we, slot)
        days[key].add(when.isoweekday())
    return {k: len(v) for k, v in days.items()}


@pytest.mark.parametrize("weekend", [MONDAY_SUNDAY, SATURDAY_SUNDAY])
def test_entries_by_brute_force(spark, weekend):
    data = random_calls(1500)
    activity = calling_activity(calls(spark, data), sites(spark), START, END, key="prefix")
    expected = [
        (*key, n, n / (2.0 if key[5] else 5.0)) for key, n in expected_entries(data, 4, weekend).items()
    ]
    assert rows(user_profile(activity, weekend)) == sorted(expected, key=repr)


@pytest.mark.parametrize("rotate", [True, False])
def test_vectors_by_brute_force(spark, rotate):
    data = random_calls(1500)
    activity = calling_activity(calls(spark, data), sites(spark), START, END, key="prefix")
    lengths = {(2014, 52): 24, (2015, 4): 12}
    vectors = {}
    for (year, week, region, user, idx, is_we, slot), n in expected_entries(data, 4, MONDAY_SUNDAY).items():
        length = lengths[year, week]
        vector = vectors.setdefault((year, week, region, user), [0.0] * length)
        # a negative index counts from the end: the first week lands in the last six entries
        vector[(idx - (1 if rotate else 0)) * 6 + is_we * 3 + slot] = n / (2.0 if is_we else 5.0)
    got = {tuple(r)[:4]: r["profile"] for r in profile_vectors(activity, rotate=rotate).collect()}
    assert got == vectors


def test_repeated_calls_change_nothing(spark):
    data = random_calls(300)
    once = calling_activity(calls(spark, data), sites(spark), START, END, key="prefix")
    thrice = calling_activity(calls(spark, data * 3), sites(spark), START, END, key="prefix")
    assert rows(once) == rows(thrice)


def test_unreadable_hours_are_left_out(spark):
    data = [(*r[:3], "8:3000" if i % 2 else r[3], *r[4:]) for i, r in enumerate(random_calls(200))]
    kept = [r for r in data if r[3] != "8:3000"]
    a = calling_activity(calls(spark, data), sites(spark), START, END, key="prefix")
    b = calling_activity(calls(spark, kept), sites(spark), START, END, key="prefix")
    assert rows(a) == rows(b)


def test_profile_takes_one_exchange_and_no_python(spark):
    df = profile_vectors(calling_activity(calls(spark, random_calls(50)), sites(spark), START, END, key="prefix"))
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in text and "Python" not in text


def test_sliding_windows_overlap(spark):
    data = random_calls(600)
    df = calls(spark, data)
    windows = W.sliding_weeks(W.weeks_available(df), size=2, shift=1)
    activity = calling_activity(df, sites(spark), size=2, windows=windows, key="prefix")
    weeks = sorted({r[4:] for r in data})
    seen = {(r["window_year"], r["window_week"]) for r in activity.collect()}
    assert seen == set(weeks)


def test_sql_profile_by_brute_force(spark):
    data = random_calls(800)
    days = defaultdict(set)
    for user, cell, when, *_ , week in data:
        region = REGION_OF.get(cell[:5])
        if region is None or not 1 <= week <= 4:
            continue
        slot = 1 if when.hour < 8 else 2 if when.hour < 19 else 3
        days[user, region, week, int(when.isoweekday() >= 6), slot].add(when.date())
    got = user_profile_sql(calls(spark, data), sites(spark), weeks=(1, 4)).collect()
    assert sorted(map(tuple, got)) == sorted((*k, len(v)) for k, v in days.items())
    order = [(r["user_id"], r["week"], r["weekday"], r["time_slot"]) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("size, shift", [(2, 1), (4, 1), (3, 2), (2, 3)])
def test_windows_merged_from_weekly_states(spark, size, shift):
    data = random_calls(400)
    df = calls(spark, data)
    cells = spark.createDataFrame([(c, f"r{i % 3}") for i, c in enumerate(sorted({r[1] for r in data}))],
                                  "cell_id string, region string")
    weeks = W.weeks_available(df)
    want = calling_activity(df, cells, size=size, windows=W.sliding_weeks(weeks, size, shift))
    states = weekly_states(df, cells)
    got = merge_weeks(states, weeks, size, shift)
    assert got.columns == want.columns and rows(got) == rows(want)
    # states that came in two loads, one of them twice
    loads = states.filter("pmod(iso_week, 2) = 0").unionByName(states)
    assert rows(merge_weeks(loads, weeks, size, shift)) == rows(want)
