"""Partitioned Parquet results and catalog tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.commit import replace_partitions
from callscape.schema import WINDOW_KEYS


def _overwrite_parts(df: DataFrame, root: str, keys: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(root)
    )


def _write_windows(df: DataFrame, root: str, tag: str, weeks, order: list[str]) -> None:
    """One folder per tag and window. The rebalance hint gathers the rows of a window into
    files of the advisory size; a large window is split over several.

    Stored windows of ``weeks``, the study's, that have no rows in this run are removed in the same
    commit. A run that fails leaves the store as it was.
    """
    if not re.fullmatch(r"[\w.-]+", tag, re.ASCII):
        raise ValueError(f"a tag names a folder: {tag!r}")
    study = {f"tag={tag}/window_year={year}/window_week={week}" for year, week in weeks or ()}
    tagged = df.withColumn("tag", F.lit(tag)).hint("rebalance", *WINDOW_KEYS)
    replace_partitions(tagged.sortWithinPartitions(*order) if order else tagged, root,
                       ["tag", *WINDOW_KEYS], study.__contains__)


def write_profiles(profiles: DataFrame, root: str, tag: str, weeks=None) -> None:
    _write_windows(profiles, root, tag, weeks, [])


def write_centroids(centroids: DataFrame, root: str, tag: str, weeks=None) -> None:
    _write_windows(centroids, root, tag, weeks, [])


def write_sociometer(shares: DataFrame, root: str, tag: str, weeks=None) -> None:
    """Class shares, sorted by region inside each window."""
    _write_windows(shares, root, tag, weeks, [*WINDOW_KEYS, "region", "user_class"])


def write_annotations(annotations: DataFrame, root: str, tag: str) -> None:
    annotations.write.mode("overwrite").parquet(f"{root}/{tag}")


def write_by_week(cdr: DataFrame, root: str, rebalance: bool = False) -> None:
    """Call records in one folder per ISO week, all weeks in one pass.

    Daily input files already hold few weeks per task, so nothing is shuffled. For input that
    is not ordered by time, ``rebalance`` gathers each week into files of the advisory size.
    """
    keys = ["iso_year", "iso_week"]
    _overwrite_parts(cdr.hint("rebalance", *keys) if rebalance else cdr, root, keys)


def write_weekly_states(states: DataFrame, root: str) -> None:
    """States of :func:`callscape.operators.profile.weekly_states`, one folder per ISO week; the weeks
    of ``states`` replace stored ones in one commit, others stay."""
    replace_partitions(states.hint("rebalance", "iso_year", "iso_week"), root, ["iso_year", "iso_week"])


def create_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """CREATE OR REPLACE TABLE ... AS, at ``path`` if given."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})
