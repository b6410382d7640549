"""Windows of weeks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscape.functions.calendar import day_of_week, iso_week, iso_year
from callscape.scale import lookup_join

# Fixed value: weeks in an analysis window.
WINDOW_WEEKS = 4

_ALL_DAYS = 0b1111111


def _as_date(value: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value.date() if isinstance(value, dt.datetime) else value


def week_calendar(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """``pos, monday, iso_year, iso_week`` for each week from ``start`` on, by steps of 7 days
    that do not pass ``end``. ``bounds`` is one row holding both dates."""
    steps = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 7 days"))
    return bounds.select(F.posexplode(steps).alias("pos", "day")).select(
        "pos",
        F.date_sub("day", day_of_week(F.col("day"))).alias("monday"),
        iso_year(F.col("day")).alias("iso_year"),
        iso_week(F.col("day")).alias("iso_week"),
    )


def weeks_between(spark: SparkSession, start, end) -> DataFrame:
    """:func:`week_calendar` for two literal dates."""
    bounds = spark.range(1).select(
        F.lit(_as_date(start)).alias("start"), F.lit(_as_date(end)).alias("end")
    )
    return week_calendar(bounds, "start", "end")


def tumbling_weeks(weeks: DataFrame, size: int = WINDOW_WEEKS) -> DataFrame:
    """Assign calendar weeks (with ``pos``) to consecutive windows of ``size`` weeks.

    The last window may be shorter. The calendar has one row per week of the study, which
    bounds the work whatever the number of records.
    """
    number = F.floor(F.col("pos") / size)
    block = Window.partitionBy("window_no")
    first = lambda name: F.min_by(name, "pos").over(block)
    return weeks.withColumn("window_no", number).select(
        first("iso_year").alias("window_year"),
        first("iso_week").alias("window_week"),
        F.count("*").over(block).cast("int").alias("n_weeks"),
        "iso_year",
        "iso_week",
        (F.col("pos") % size).cast("int").alias("week_idx"),
    )


def ranked_weeks(weeks: DataFrame) -> DataFrame:
    """Distinct ISO weeks with their position ``pos`` from 0; the calendar has a row per week."""
    return weeks.select("iso_year", "iso_week").withColumn(
        "pos", (F.row_number().over(Window.orderBy("iso_year", "iso_week")) - 1).cast("bigint"))


def sliding_weeks(weeks: DataFrame, size: int = WINDOW_WEEKS, shift: int = 1) -> DataFrame:
    """Windows of up to ``size`` available weeks, one starting every ``shift`` weeks.

    ``weeks`` holds distinct ISO weeks; gaps are stepped over. A week appears once per
    window it belongs to.
    """
    ranked = ranked_weeks(weeks)
    last = F.floor(F.col("pos") / shift) * shift
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / shift) * shift, F.lit(0))
    block = Window.partitionBy("begin")
    lead = lambda name: F.min_by(name, "pos").over(block)
    return (
        ranked.filter(first <= last)
        .withColumn("begin", F.explode(F.sequence(first, last, F.lit(shift).cast("bigint"))))
        .select(
            lead("iso_year").alias("window_year"),
            lead("iso_week").alias("window_week"),
            F.count("*").over(block).cast("int").alias("n_weeks"),
            "iso_year",
            "iso_week",
            (F.col("pos") - F.col("begin")).cast("int").alias("week_idx"),
        )
    )


def in_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Keep the records of weeks in ``windows`` and add the window columns.

    The windows are measured before they are broadcast.
    """
    return lookup_join(df, windows, ["iso_year", "iso_week"])


def assign_tumbling(
    df: DataFrame, start, end, size: int = WINDOW_WEEKS, date: str = "date"
) -> DataFrame:
    """Add ``window_year, window_week, n_weeks, week_idx`` of the tumbling windows from
    ``start`` to ``end`` and drop records outside them.

    Calendar weeks are consecutive, so the window follows from the distance to the first
    Monday. No join is needed, and the range check on ``date`` reaches the scan.
    """
    start, end = _as_date(start), _as_date(end)
    if end < start:
        raise ValueError("the study ends before it starts")
    monday = start - dt.timedelta(days=start.weekday())
    n_total = (end - start).days // 7 + 1
    beyond = monday + dt.timedelta(weeks=n_total)
    midnight = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    whole = lambda a, b: F.call_function("div", a, F.lit(b)).cast("int")
    pos = whole(F.date_diff(F.to_date(date), F.lit(monday)), 7)
    number = whole(pos, size)
    first_day = F.date_add(F.lit(monday), number * (7 * size))
    return df.filter((F.col(date) >= midnight(monday)) & (F.col(date) < midnight(beyond))).withColumns(
        {
            "window_year": iso_year(first_day),
            "window_week": iso_week(first_day),
            "n_weeks": F.least(F.lit(size), F.lit(n_total) - number * size),
            "week_idx": pos % size,
        }
    )


def complete_weeks(df: DataFrame) -> DataFrame:
    """ISO weeks with records on all seven days. Days are collected as bits, in one exchange."""
    days = F.bit_or(F.call_function("shiftleft", F.lit(1), day_of_week(F.col("date"))))
    return (
        df.groupBy("iso_year", "iso_week")
        .agg(days.alias("days"))
        .filter(F.col("days") == _ALL_DAYS)
        .drop("days")
    )


def weeks_available(df: DataFrame) -> DataFrame:
    """Distinct ISO weeks of the records."""
    return df.select("iso_year", "iso_week").distinct()


def require_weeks(weeks: DataFrame, n: int = WINDOW_WEEKS) -> DataFrame:
    """The weeks in order; raises when there are fewer than ``n``."""
    if len(weeks.take(n)) < n:
        raise ValueError(f"fewer than {n} weeks of data")
    return weeks.orderBy("iso_year", "iso_week")
