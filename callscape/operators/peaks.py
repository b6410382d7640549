"""Peaks: hours in which a cell is busier than its usual share of the day.

Every step is keyed by year: a year's days are compared with the base period of the same year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.calendar import slot_hour

# Base period and first analysed day of the year, and the peak thresholds.
BASE_DAYS = (32, 58)
FROM_DAY = 59
BIN = 0.1
MIN_RATIO = 0.2
MIN_DIFF = 50
STUDY_CELLS = 10

#: Decimals of a ratio that count, so that summation order cannot move it over a bucket edge.
RATIO_DECIMALS = 12


def in_period(cdr: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Call records from the day ``start`` to the day ``end``, both included."""
    day = F.to_date("date")
    if start is not None:
        cdr = cdr.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        cdr = cdr.filter(day <= F.lit(end).cast("date"))
    return cdr


def with_peak_calendar(
    cdr: DataFrame, cell: str = "start_cell", clock_in_date: bool = True
) -> DataFrame:
    """``id, hour, dow, doy, year`` of call records, the columns peak detection works on.

    The hour comes from the time text. Where that has none, the clock of the date counts, unless
    ``clock_in_date`` says that dates have no clock; then the record has no hour and is left out.
    """
    date = F.col("date")
    hour = slot_hour(F.col("time"))
    return cdr.select(
        F.col(cell).alias("id"),
        (F.coalesce(hour, F.hour(date)) if clock_in_date else hour).alias("hour"),
        (F.weekday(date) + 1).alias("dow"),
        F.dayofyear(date).alias("doy"),
        F.year(date).alias("year"),
    ).filter("hour is not null")


def during(calls: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Calls with calendar columns from the day ``start`` to the day ``end``, both included."""
    if start is None and end is None:
        return calls
    day = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy") - 1)
    return in_period(calls.withColumn("date", day), start, end).drop("date")


def study_cells(calls: DataFrame, n: int = STUDY_CELLS) -> DataFrame:
    """The first ``n`` cells in order."""
    return calls.select(F.col("id").alias("nidt")).distinct().orderBy("nidt").limit(n)


def call_counts(calls: DataFrame) -> DataFrame:
    """Calls per cell, hour, day of week, day of year and year."""
    return calls.groupBy("id", "hour", "dow", "doy", "year").agg(F.count("*").alias("num"))


def _of_cells(counts: DataFrame, cells: DataFrame | None) -> DataFrame:
    wanted = counts if cells is None else counts.join(
        cells.select(F.col("nidt").alias("id")), "id", "left_semi"
    )
    return wanted.withColumnRenamed("id", "rid")


def peak_base(
    counts: DataFrame, cells: DataFrame | None = None, doy_range: tuple[int, int] = BASE_DAYS
) -> DataFrame:
    """Usual calls per cell, hour and day of week: the mean over the year's base period."""
    return (
        _of_cells(counts.filter(F.col("doy").between(*doy_range)), cells)
        .groupBy("rid", "hour", "dow", "year")
        .agg(F.avg("num").alias("num"))
    )


def peak_analysis(
    counts: DataFrame, cells: DataFrame | None = None, from_doy: int = FROM_DAY
) -> DataFrame:
    """Calls of the analysed days."""
    return _of_cells(counts.filter(F.col("doy") >= from_doy), cells).select(
        "rid", "hour", "doy", "dow", "year", "num"
    )


def peak_ratio(analysis: DataFrame, base: DataFrame) -> DataFrame:
    """How far a cell's share of the day's calls departs from its usual share.

    Totals are over the studied cells only. They have at most 366 rows, or 7, a year and are
    broadcast. Both are unique on their keys, so no analysed row is multiplied.
    """
    per_day = analysis.groupBy("year", "doy").agg(F.sum("num").alias("day_total"))
    per_dow = base.groupBy("year", "dow").agg(F.sum("num").alias("dow_total"))
    usual = base.withColumnRenamed("num", "bnum")
    share = F.col("anum") / F.col("day_total").cast("double")
    usual_share = F.col("bnum") / F.col("dow_total")
    return (
        analysis.withColumnRenamed("num", "anum")
        .join(usual, ["rid", "hour", "dow", "year"])
        .join(F.broadcast(per_day), ["year", "doy"])
        .join(F.broadcast(per_dow), ["year", "dow"])
        .select("rid", "hour", "doy", "dow", "year", (share / usual_share - 1.0).alias("ratio"), "anum", "bnum")
    )


def bucket_ratio(ratio: Column, bin: float = BIN) -> Column:
    """Signed ratio moved down to its bucket."""
    return F.round(F.abs(ratio / bin) - 0.5) * bin * F.signum(ratio)


def peaks(
    ratios: DataFrame,
    bin: float = BIN,
    min_ratio: float = MIN_RATIO,
    min_diff: float = MIN_DIFF,
    positive_only: bool = True,
) -> DataFrame:
    """Departures that are large both in ratio and in calls."""
    ratio = F.round("ratio", RATIO_DECIMALS)
    diff = F.abs(F.col("anum") - F.col("bnum"))
    large = (F.abs(ratio) >= min_ratio) & (diff >= min_diff)
    if positive_only:
        large = large & (ratio > 0)
    return ratios.filter(large).select(
        "rid", "hour", "doy", "dow", "year",
        bucket_ratio(ratio, bin).alias("ratio"),
        F.abs("ratio").alias("abs_ratio"),
        diff.alias("abs_diff"),
    )
