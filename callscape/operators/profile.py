"""User calling profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.calendar import (
    MONDAY_SUNDAY,
    SATURDAY_SUNDAY,
    SLOT_EDGES,
    day_of_week,
    day_slot_sql,
    is_weekend,
    iso_week,
    iso_year,
    slot_hour,
    slot_of_hour,
)
from callscape.operators.spatial import attach_region
from callscape.operators.windows import (
    WINDOW_WEEKS,
    assign_tumbling,
    in_window,
    ranked_weeks,
    sliding_weeks,
)
from callscape.scale import lookup_join
from callscape.schema import WINDOW_KEYS

SLOTS = 3
DAYS = 7

# Days by which work-day and weekend activity is divided.
WORKDAY_DIVISOR = 5.0
WEEKEND_DIVISOR = 2.0


def user_profile_sql(
    cdr: DataFrame,
    cells: DataFrame,
    weeks: tuple[int, int] = (8, 12),
    weekend: Iterable[int] = SATURDAY_SUNDAY,
    strict_site: bool = False,
) -> DataFrame:
    """Active days per user, area, week, weekend flag and time slot, in that order.

    ``weeks`` bounds the ISO week number, both ends included. The days of a week are bits, so
    all calls of a user in a slot become one row before the exchange; a week number that comes
    up in several years counts the days of each.
    """
    date = F.col("date")
    placed = attach_region(cdr.filter(iso_week(date).between(*weeks)), cells, "prefix",
                           strict_site=strict_site)
    keys = ["user_id", "region", "week", "weekday", "time_slot"]
    by_year = (
        placed.select(
            "user_id",
            "region",
            iso_week(date).alias("week"),
            is_weekend(date, weekend).alias("weekday"),
            day_slot_sql(date).alias("time_slot"),
            iso_year(date).alias("year"),
            F.call_function("shiftleft", F.lit(1), day_of_week(date)).alias("day"),
        )
        .groupBy(*keys, "year")
        .agg(F.bit_or("day").alias("days"))
    )
    return (
        by_year.groupBy(*keys)
        .agg(F.sum(F.bit_count("days")).alias("n_days"))
        .orderBy("user_id", "week", "weekday", "time_slot", "region")
    )


def untimed_records(cdr: DataFrame) -> DataFrame:
    """Records whose time text has no hour, which profiles leave out."""
    return cdr.filter(slot_hour(F.col("time")).isNull())


def _timed_in_region(cdr: DataFrame, cells: DataFrame, key: str, strict_site: bool) -> DataFrame:
    timed = cdr.withColumn("_hour", slot_hour(F.col("time"))).filter("_hour is not null")
    return attach_region(timed, cells, key, strict_site=strict_site)


def _active_bit(edges: tuple[int, int]) -> Column:
    """The bit of a call's (slot, day of week)."""
    bit = slot_of_hour(F.col("_hour"), edges) * DAYS + day_of_week(F.col("date"))
    return F.call_function("shiftleft", F.lit(1), bit)


def weekly_states(
    cdr: DataFrame,
    cells: DataFrame,
    key: str = "exact",
    edges: tuple[int, int] = SLOT_EDGES,
    strict_site: bool = False,
) -> DataFrame:
    """One integer per user, region and ISO week with a bit for each active (slot, day of week).

    A week's states never change when other weeks arrive, so they can be stored once and merged into
    any windows by :func:`merge_weeks`. States of the same week from several inputs merge by
    ``bit_or``.
    """
    return (
        _timed_in_region(cdr, cells, key, strict_site)
        .groupBy("iso_year", "iso_week", "region", "user_id")
        .agg(F.bit_or(_active_bit(edges)).alias("mask"))
    )


def merge_weeks(
    states: DataFrame, weeks: DataFrame, size: int = WINDOW_WEEKS, shift: int = 1
) -> DataFrame:
    """The activity of :func:`calling_activity` over sliding windows of ``weeks``, from weekly states.

    Each state takes part once: the weeks of a user and region meet in one exchange as a map from
    position in the calendar to mask, which holds at most one integer per week of the study. Its
    windows are read off that map, so neither calls nor states are copied per window. ``weeks`` and
    the windows have a row per week; both are measured before they are broadcast.
    """
    calendar = ranked_weeks(weeks)
    bounds = sliding_weeks(weeks, size, shift).filter("week_idx = 0").join(
        calendar, ["iso_year", "iso_week"]).select(
        F.col("pos").alias("begin"), *WINDOW_KEYS, "n_weeks")
    placed = lookup_join(states, calendar, ["iso_year", "iso_week"])
    users = placed.groupBy("region", "user_id", "pos").agg(F.bit_or("mask").alias("mask")).groupBy(
        "region", "user_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "mask"))).alias("masks"))
    step = F.lit(shift).cast("bigint")
    last = lambda pos: F.floor(pos / step) * step
    first = lambda pos: F.greatest(F.ceil((pos - (size - 1)) / step) * step, F.lit(0).cast("bigint"))
    begins = F.array_distinct(F.flatten(F.transform(
        F.map_keys("masks"), lambda pos: F.when(
            first(pos) <= last(pos), F.sequence(first(pos), last(pos), step))
        .otherwise(F.array().cast("array<bigint>")))))
    windows = users.select("region", "user_id", "masks", F.explode(begins).alias("begin"))
    masks = [F.coalesce(F.try_element_at("masks", F.col("begin") + week), F.lit(0)).alias(f"mask_{week}")
             for week in range(size)]
    return lookup_join(windows, bounds, "begin").select(
        *WINDOW_KEYS, "n_weeks", "region", "user_id", *masks)


def calling_activity(
    cdr: DataFrame,
    cells: DataFrame,
    start=None,
    end=None,
    size: int = WINDOW_WEEKS,
    windows: DataFrame | None = None,
    key: str = "exact",
    edges: tuple[int, int] = SLOT_EDGES,
    strict_site: bool = False,
) -> DataFrame:
    """Which days and slots each user was active in, per window and region.

    One integer per week of the window holds a bit for each (slot, day of week). Setting bits
    replaces a distinct followed by a count: repeated calls vanish before the exchange, and
    the whole profile needs that single exchange, keyed by (window, region, user).

    Windows are the tumbling ones from ``start`` to ``end``, or any given ``windows`` frame.
    Records without a readable hour have no slot and are left out; :func:`untimed_records` has
    them.
    """
    in_region = _timed_in_region(cdr, cells, key, strict_site)
    placed = in_window(in_region, windows) if windows is not None \
        else assign_tumbling(in_region, start, end, size)
    flag = _active_bit(edges)
    masks = [
        F.bit_or(F.when(F.col("week_idx") == week, flag).otherwise(0)).alias(f"mask_{week}")
        for week in range(size)
    ]
    return placed.groupBy(*WINDOW_KEYS, "n_weeks", "region", "user_id").agg(*masks)


def _mask_columns(activity: DataFrame) -> list[str]:
    return [c for c in activity.columns if c.startswith("mask_")]


def _active_days(mask: str, is_we: int, slot: int, weekend: Iterable[int]) -> str:
    """SQL text counting the active days of a week's mask in one slot."""
    weekend_bits = sum(1 << (day - 1) for day in set(weekend))
    bits = weekend_bits if is_we else weekend_bits ^ ((1 << DAYS) - 1)
    return f"bit_count({mask} & {bits << (slot * DAYS)})"


def _normalised(days: str, is_we: int) -> str:
    return f"{days} / {WEEKEND_DIVISOR if is_we else WORKDAY_DIVISOR}D"


def _week_parts():
    return [(is_we, slot) for is_we in (0, 1) for slot in range(SLOTS)]


def user_profile(activity: DataFrame, weekend: Iterable[int] = MONDAY_SUNDAY) -> DataFrame:
    """Long form of the activity: one row per week, weekend flag and slot with any call.

    ``n_days`` counts the distinct active days, ``value`` is that count over the work days or
    weekend days of a week.
    """
    weekend = tuple(weekend)
    entries = []
    for week, mask in enumerate(_mask_columns(activity)):
        for is_we, slot in _week_parts():
            days = _active_days(mask, is_we, slot, weekend)
            entries.append(
                f"named_struct('week_idx', {week}, 'is_we', {is_we}, 'slot', {slot}, "
                f"'n_days', {days}, 'value', {_normalised(days, is_we)})"
            )
    return activity.selectExpr(
        *WINDOW_KEYS, "region", "user_id", f"inline(array({', '.join(entries)}))"
    ).filter("n_days > 0")


def profile_vectors(
    activity: DataFrame, weekend: Iterable[int] = MONDAY_SUNDAY, rotate: bool = True
) -> DataFrame:
    """Dense profile of six entries per week of the window, zeros included.

    Inside a week the entry is ``is_we * 3 + slot``. With ``rotate`` the first week comes
    last, which is the order the labelled typical profiles are compared in.
    """
    weekend = tuple(weekend)
    masks = _mask_columns(activity)
    entries = []
    for block in range(len(masks)):
        week = f"pmod({block + 1}, n_weeks)" if rotate else str(block)
        mask = f"get(array({', '.join(masks)}), {week})"
        for is_we, slot in _week_parts():
            entries.append(_normalised(_active_days(mask, is_we, slot, weekend), is_we))
    profile = f"slice(array({', '.join(entries)}), 1, n_weeks * {2 * SLOTS}) AS profile"
    return activity.selectExpr(*WINDOW_KEYS, "region", "user_id", profile)
