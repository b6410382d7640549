import datetime as dt

import pytest
from pyspark.sql import functions as F

from callscape.operators import windows as W

from helpers import calls, plan, random_calls, rows


def test_weeks_cross_a_long_year(spark):
    got = W.weeks_between(spark, "2015-12-23", "2016-01-13").orderBy("pos").collect()
    assert [(r["iso_year"], r["iso_week"]) for r in got] == [(2015, 52), (2015, 53), (2016, 1), (2016, 2)]
    assert got[1]["monday"] == dt.date(2015, 12, 28)


def test_last_step_may_leave_a_week_out(spark):
    # Friday plus seven days passes the Thursday it ends on
    assert W.weeks_between(spark, "2024-01-05", "2024-01-11").count() == 1


def test_tumbling_windows(spark):
    weeks = W.weeks_between(spark, "2015-12-07", "2016-01-10")
    got = rows(W.tumbling_weeks(weeks).select("iso_week", "window_year", "window_week", "n_weeks", "week_idx"))
    assert got == sorted([(50, 2015, 50, 4, 0), (51, 2015, 50, 4, 1), (52, 2015, 50, 4, 2),
                          (53, 2015, 50, 4, 3), (1, 2016, 1, 1, 0)], key=repr)


@pytest.mark.parametrize("start, end", [("2014-12-25", "2015-01-27"), ("2015-01-01", "2015-01-07"),
                                        ("2014-12-22", "2015-01-19")])
def test_arithmetic_and_joined_windows_agree(spark, start, end):
    df = calls(spark, random_calls(400))
    columns = ["user_id", "date", "window_year", "window_week", "n_weeks", "week_idx"]
    direct = W.assign_tumbling(df, start, end, size=3)
    joined = W.in_window(df, W.tumbling_weeks(W.weeks_between(spark, start, end), size=3))
    assert rows(direct.select(*columns)) == rows(joined.select(*columns))
    assert direct.count() > 0


def test_period_reaches_the_scan(spark, tmp_path):
    calls(spark, random_calls(20)).write.parquet(str(tmp_path / "c"))
    df = W.assign_tumbling(spark.read.parquet(str(tmp_path / "c")), "2015-01-05", "2015-01-20")
    text = plan(df)
    assert "GreaterThanOrEqual(date,2015-01-05" in text and "LessThan(date,2015-01-26" in text
    assert "Join" not in text and "Exchange" not in text
    with pytest.raises(ValueError):
        W.assign_tumbling(df, "2015-01-05", "2015-01-04")


@pytest.mark.parametrize("size, shift", [(4, 1), (4, 2), (2, 3), (3, 3)])
def test_sliding_windows_step_over_gaps(spark, size, shift):
    weeks = [(2014, 50), (2014, 52), (2015, 1), (2015, 2), (2015, 5), (2015, 6), (2015, 9)]
    df = spark.createDataFrame(weeks[::-1], "iso_year int, iso_week int")
    expected = []
    for begin in range(0, len(weeks), shift):
        members = weeks[begin : begin + size]
        expected += [(*weeks[begin], len(members), *w, i) for i, w in enumerate(members)]
    assert rows(W.sliding_weeks(df, size, shift)) == sorted(expected, key=repr)


def test_complete_and_available_weeks(spark):
    from helpers import call

    monday = dt.datetime(2024, 1, 1, 12)
    full = [call("u", "c", monday + dt.timedelta(days=i)) for i in range(7)]
    partial = [call("u", "c", monday + dt.timedelta(days=7 + i)) for i in (0, 1, 2, 3, 4, 5, 5, 0)]
    df = calls(spark, full + partial)
    assert rows(W.complete_weeks(df)) == [(2024, 1)]
    assert rows(W.weeks_available(df)) == [(2024, 1), (2024, 2)]
    assert plan(W.complete_weeks(df)).count("Exchange") == 1


def test_required_weeks(spark):
    df = spark.createDataFrame([(2024, 3), (2024, 1), (2023, 52)], "iso_year int, iso_week int")
    got = [tuple(r) for r in W.require_weeks(df, 3).collect()]
    assert got == [(2023, 52), (2024, 1), (2024, 3)]
    with pytest.raises(ValueError):
        W.require_weeks(df)
