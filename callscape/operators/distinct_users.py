"""Exact distinct users as mergeable bitmaps.

Users are numbered once, densely. A state holds, for a region, date and class, the users of one
block of numbers as a bit set of fixed size. States of seconds or hours merge to days, and states of
regions or classes to larger wholes, by OR: nothing is counted twice and no call is read again. Both
aggregates combine inside each task before their exchange, so a hot region moves one bit set per task
and block.

Numbers ascend by region and then by user, which puts users of one region into the same blocks; numbers
given once never change, and new users continue after the last. A null user counts as one user, as in
``presence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions.calendar import at_grain
from callscape.operators.presence import presence_users
from callscape.scale import with_row_number
from callscape.schema import NOT_CLASSIFIED

STATE_KEYS = ("region", "date", "user_class")


def _same_user(left: DataFrame, right: DataFrame):
    return left["user_id"].eqNullSafe(right["user_id"])


def number_users(seen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``user_id, user_no`` of all users of ``seen`` (user_id, region), numbered from 1.

    With ``known``, an earlier result, its numbers stay and only new users are added.
    """
    users = seen.groupBy("user_id").agg(F.min("region").alias("_region"))
    last = 0
    if known is not None:
        last = known.agg(F.max("user_no")).first()[0] or 0
        users = users.join(known, _same_user(users, known), "left_anti")
    added = with_row_number(users, ["_region", "user_id"], "_row").select(
        "user_id", (F.col("_row") + last + 1).alias("user_no"))
    return added if known is None else known.select("user_id", "user_no").unionByName(added)


def presence_states(
    cdr: DataFrame,
    cells: DataFrame,
    annotations: DataFrame,
    numbers: DataFrame,
    grain: str | None = "hour",
    key: str = "prefix",
    strict_site: bool = False,
) -> DataFrame:
    """``region, date, user_class, block, users``: who was seen, as bit sets.

    ``numbers`` must hold every user of ``cdr``; a user without a number fails the job. A user with
    two classes in a region is in the bit sets of both.
    """
    seen = presence_users(cdr, cells, grain, key, strict_site)
    labels = annotations.select("user_id", "region", "user_class").distinct()
    numbered = seen.join(numbers.withColumnRenamed("user_id", "_known"),
                         F.col("user_id").eqNullSafe(F.col("_known")), "left").drop("_known")
    missing = F.raise_error(F.lit("a user has no number")).cast("long")
    number = F.coalesce("user_no", missing)
    return (
        numbered.join(labels, ["user_id", "region"], "left")
        .groupBy("region", "date", F.coalesce("user_class", F.lit(NOT_CLASSIFIED)).alias("user_class"),
                 F.bitmap_bucket_number(number).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("users"))
    )


def merge_states(states: DataFrame, grain: str | None = None,
                 keys: tuple[str, ...] = STATE_KEYS) -> DataFrame:
    """States of a coarser grain, and of fewer ``keys`` if some are left out."""
    moved = states.withColumn("date", at_grain(F.col("date"), grain))
    return moved.groupBy(*keys, "block").agg(F.bitmap_or_agg("users").alias("users"))


def count_users(states: DataFrame, keys: tuple[str, ...] = STATE_KEYS) -> DataFrame:
    """Distinct users per key of states that were merged to ``keys``."""
    return states.groupBy(*keys).agg(F.sum(F.bitmap_count("users")).alias("n_users"))


def presence_from_states(states: DataFrame, grain: str | None = None,
                         keys: tuple[str, ...] = STATE_KEYS) -> DataFrame:
    """Users per key, each once, from states of the same or a finer grain."""
    return count_users(merge_states(states, grain, keys), keys)
