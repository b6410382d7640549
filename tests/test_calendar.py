import datetime as dt

import pytest
from pyspark.sql import functions as F

from callscape.functions import calendar as cal


def test_iso_week_at_year_ends(spark):
    days = [dt.datetime(2015, 12, 31), dt.datetime(2016, 1, 3), dt.datetime(2016, 1, 4),
            dt.datetime(2018, 12, 31), dt.datetime(2021, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = df.select(cal.iso_year(F.col("d")), cal.iso_week(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [d.isocalendar()[:2] for d in days]


@pytest.mark.parametrize(
    "preset, expected",
    [
        (cal.MONDAY_SUNDAY, [1, 0, 0, 0, 0, 0, 1]),
        (cal.SATURDAY_SUNDAY, [0, 0, 0, 0, 0, 1, 1]),
        (cal.MONDAY_TO_FRIDAY, [1, 1, 1, 1, 1, 0, 0]),
    ],
)
def test_weekend_presets(spark, preset, expected):
    monday = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(i, monday + dt.timedelta(days=i)) for i in range(7)], "i int, d timestamp_ntz"
    )
    got = df.select("i", cal.is_weekend(F.col("d"), preset).alias("w"),
                    cal.day_of_week(F.col("d")).alias("d0"), cal.day_of_week(F.col("d"), 1).alias("d1"))
    got = got.orderBy("i").collect()
    assert [r["w"] for r in got] == expected
    assert [(r["d0"], r["d1"]) for r in got] == [(i, i + 1) for i in range(7)]


def test_slots_of_time_text(spark):
    texts = {"000000": 0, "085959": 0, "090000": 1, "185959": 1, "190000": 2, " 9 3000": 2,
             "8:30": None, "": None, "xx": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", cal.day_slot(F.col("t")).alias("s")).collect()}
    assert got == texts  # " 9 3000" reads as hour 93


def test_slots_of_timestamp(spark):
    times = ["00:00:00", "07:59:59", "08:00:00", "18:59:59", "19:00:00", "23:59:59"]
    df = spark.createDataFrame([(f"2024-01-01 {t}",) for t in times], "t string")
    got = df.select(cal.day_slot_sql(F.col("t").cast("timestamp_ntz"))).collect()
    assert [r[0] for r in got] == [1, 1, 2, 2, 3, 3]


def test_date_formats():
    assert cal.datetime_pattern("%Y-%m-%d %X") == "yyyy-M-d H:m:s"
    assert cal.datetime_pattern("%Y%m%d") == "yyyyMMdd"
    assert cal.datetime_pattern("%d/%m/%Y T%H") == "d/M/yyyy 'T'H"
    assert cal.datetime_pattern("dd.MM.yyyy") == "dd.MM.yyyy"
    with pytest.raises(ValueError):
        cal.datetime_pattern("%Q")


def test_parsing_ignores_session_time_zone(spark):
    # 02:30 does not exist in New York on that day, and 01:30 exists twice in November
    texts = ["2024-03-10 02:30:00", "2024-3-10 2:30:00", "2024-11-03 01:30:00",
             "2024-02-30 00:00:00", "2024-01-01", "2024-01-01 00:00:00 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cal.parse_timestamp(F.col("t"), "yyyy-M-d H:m:s")).collect()]
    gap = dt.datetime(2024, 3, 10, 2, 30)
    assert got == [gap, gap, dt.datetime(2024, 11, 3, 1, 30), None, None, None]


def test_grain(spark):
    when = dt.datetime(2024, 3, 10, 2, 30, 15)
    df = spark.createDataFrame([(when,)], "d timestamp_ntz")
    got = df.select(*[cal.at_grain(F.col("d"), g).alias(str(g)) for g in (None, "day", "hour")]).first()
    assert tuple(got) == (when, dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 10, 2))
    with pytest.raises(ValueError):
        cal.at_grain(F.col("d"), "minute")
