"""Results as observation records for a statistics service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.calendar import epoch_seconds
from callscape.scale import with_row_number

# The indicators, the id prefixes and the base address of record links.
PRESENCE_INDICATOR = "area_presence"
OD_INDICATOR = "origin_destination"
SOCIOMETER_INDICATOR = "category_percentage"
PRESENCE_ID = "presence-"
OD_ID = "od-"
SOCIOMETER_ID = "sociometer-"
RECORD_URI = "http://example.com/"


def _observations(
    df: DataFrame, order_by: list[str], prefix: str, indicator: str,
    value: str, date: Column, region: str, description: str,
) -> DataFrame:
    numbered = with_row_number(df, order_by, "_row")
    return numbered.select(
        F.concat(F.lit(prefix), F.col("_row").cast("string")).alias("_id"),
        F.col(value).cast("string").alias("value"),
        date.cast("string").alias("date"),
        F.col(region).alias("region_id"),
        F.col(description).alias("description"),
        F.lit(indicator).alias("indicator_id"),
        F.lit(indicator).alias("indicator_name"),
    )


def presence_observations(presence: DataFrame) -> DataFrame:
    """One observation per presence row: the region counts, the class describes."""
    return _observations(
        presence, ["region", "date", "user_class"], PRESENCE_ID, PRESENCE_INDICATOR,
        "n_users", F.col("date"), "region", "user_class",
    )


def od_observations(od: DataFrame) -> DataFrame:
    """One observation per origin-destination row: region is the origin, the destination describes."""
    return _observations(
        od, ["destination", "date", "origin"], OD_ID, OD_INDICATOR,
        "n_users", F.col("date"), "origin", "destination",
    )


def week_sunday(year: Column, week: Column, legacy: bool = False) -> Column:
    """Sunday of a week. Weeks are ISO weeks; ``legacy`` counts them from the first Monday of
    the year instead, which is a week later in years that start on Tuesday to Thursday."""
    anchor = F.make_date(year, F.lit(1), F.lit(1 if legacy else 4))
    offset = F.pmod(7 - F.weekday(anchor), F.lit(7)) if legacy else -F.weekday(anchor)
    return F.date_add(anchor, (offset + (week - 1) * 7 + 6).cast("int"))


def sociometer_observations(shares: DataFrame, legacy_week: bool = False) -> DataFrame:
    """One observation per class share, dated on the Sunday of the window's first week."""
    sunday = week_sunday(F.col("window_year"), F.col("window_week"), legacy_week)
    return _observations(
        shares, ["window_year", "window_week", "region", "user_class"],
        SOCIOMETER_ID, SOCIOMETER_INDICATOR,
        "share", sunday.cast("timestamp_ntz"), "region", "user_class",
    )


def to_api_records(
    observations: DataFrame, indicator_id: str, added_date: int, time_zone: str = "UTC"
) -> DataFrame:
    """Observations in the shape the service takes, times as epoch-second text.

    ``added_date`` is given, so that a rerun yields the same records. Records keep a
    ``target_location`` when there is one, and refer to their region otherwise.
    """
    record_id = F.concat(F.lit(indicator_id + "_"), F.col("_id"))
    in_utc = F.convert_timezone(
        F.lit(time_zone), F.lit("UTC"), F.col("date").cast("timestamp_ntz")
    )
    place = "target_location" if "target_location" in observations.columns else None
    return observations.select(
        record_id.alias("_id"),
        F.lit(indicator_id).alias("indicator_id"),
        F.lit(indicator_id).alias("indicator_name"),
        F.concat(F.lit(f"{RECORD_URI}{indicator_id}/"), record_id).alias("uri"),
        F.lit(str(added_date)).alias("added_date"),
        epoch_seconds(in_utc).cast("string").alias("date"),
        "value",
        "description",
        F.col(place) if place else F.col("region_id").alias("location_id"),
    )


def as_json(records: DataFrame) -> DataFrame:
    """Each record as one JSON text in ``value``."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))
