"""Presence, origin-destination and hourly activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions.calendar import at_grain
from callscape.operators.spatial import attach_region
from callscape.schema import DYNAMIC_RESIDENT, NOT_CLASSIFIED, OUTBOUND, RESIDENT

HOME_CLASSES = (RESIDENT, DYNAMIC_RESIDENT)


def presence_users(
    cdr: DataFrame,
    cells: DataFrame,
    grain: str | None = None,
    key: str = "prefix",
    strict_site: bool = False,
) -> DataFrame:
    """Distinct ``user_id, region, date``: who was seen where and when.

    Repeated records collapse inside each task before they are exchanged.
    """
    placed = attach_region(cdr, cells, key, strict_site=strict_site)
    return placed.select("user_id", "region", at_grain(F.col("date"), grain).alias("date")).distinct()


def presence(
    cdr: DataFrame,
    cells: DataFrame,
    annotations: DataFrame,
    grain: str | None = None,
    key: str = "prefix",
    strict_site: bool = False,
) -> DataFrame:
    """Users per region, date and class.

    Records are made distinct before the labels join, and both join inputs come straight
    from an exchange, so a user with very many rows is split by the adaptive skew join. A
    user with two classes in a region counts in both.
    """
    seen = presence_users(cdr, cells, grain, key, strict_site)
    labels = annotations.select("user_id", "region", "user_class").distinct()
    return (
        seen.join(labels, ["user_id", "region"], "left")
        .groupBy("region", "date", F.coalesce("user_class", F.lit(NOT_CLASSIFIED)).alias("user_class"))
        .agg(F.count("*").alias("n_users"))
    )


def od_matrix(
    cdr: DataFrame,
    cells: DataFrame,
    annotations: DataFrame,
    grain: str | None = None,
    key: str = "prefix",
    strict_site: bool = False,
) -> DataFrame:
    """Users per origin, destination and date.

    The origin is each region the user lives in; users who live in none come from outside.
    """
    seen = presence_users(cdr, cells, grain, key, strict_site).withColumnRenamed("region", "destination")
    homes = (
        annotations.filter(F.col("user_class").isin(*HOME_CLASSES))
        .select("user_id", F.col("region").alias("origin"))
        .distinct()
    )
    return (
        seen.join(homes, "user_id", "left")
        .groupBy(F.coalesce("origin", F.lit(OUTBOUND)).alias("origin"), "destination", "date")
        .agg(F.count("*").alias("n_users"))
    )


def hourly_activity(
    cdr: DataFrame,
    cells: DataFrame,
    grain: str | None = None,
    key: str = "exact",
    strict_site: bool = False,
) -> DataFrame:
    """Distinct (user, cell) pairs per region, date and hour, and the cells involved.

    Pairs are first counted per cell, which combines before its exchange; only then are the
    cells of a region gathered, so the gathered list is bounded by the cell dimension.
    """
    moment = ["region", "date", "hour"]
    pairs = attach_region(cdr, cells, key, strict_site=strict_site).select(
        "region",
        at_grain(F.col("date"), grain).alias("date"),
        F.substring("time", 1, 2).alias("hour"),
        "start_cell",
        "user_id",
    ).distinct()
    return (
        pairs.groupBy(*moment, "start_cell")
        .agg(F.count("*").alias("n"))
        .groupBy(*moment)
        .agg(
            F.sum("n").alias("n_calls"),
            F.sort_array(F.collect_list("start_cell")).alias("cells"),
        )
    )
