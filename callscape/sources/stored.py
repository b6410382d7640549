"""Results stored by the sinks, read back by tag and window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscape.commit import recover
from callscape.schema import CENTROID_SCHEMA, PROFILE_SCHEMA, SHARE_SCHEMA, WEEK_STATE_SCHEMA

LABELLED_CENTROID_SCHEMA = T.StructType(
    [*CENTROID_SCHEMA.fields, T.StructField("label", T.StringType())])


def _stored(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The store at ``root``, or no rows if nothing was written there yet. A tag is text: the tags
    ``1`` and ``01`` differ."""
    whole = T.StructType([*schema.fields, T.StructField("tag", T.StringType())])
    return _read(spark, root, whole)


def _read(spark: SparkSession, root: str, whole: T.StructType) -> DataFrame:
    recover(spark, root)
    try:
        return spark.read.schema(whole).parquet(root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def of_windows(df: DataFrame, weeks: Iterable[tuple[int, int]]) -> DataFrame:
    wanted = F.lit(False)
    for year, week in weeks:
        wanted = wanted | ((F.col("window_year") == year) & (F.col("window_week") == week))
    return df.filter(wanted)


def _by_window(spark, root, tag, weeks, schema) -> DataFrame:
    found = _stored(spark, root, schema).filter(F.col("tag") == tag).drop("tag")
    return found if weeks is None else of_windows(found, weeks)


def read_profiles(spark, root, tag, weeks=None) -> DataFrame:
    """Stored profile vectors; a window without data gives no rows. Prunes partitions."""
    return _by_window(spark, root, tag, weeks, PROFILE_SCHEMA)


def read_centroids(spark, root, tag, weeks=None) -> DataFrame:
    """Stored labelled centroids. Prunes partitions."""
    return _by_window(spark, root, tag, weeks, LABELLED_CENTROID_SCHEMA)


def read_sociometer(spark, root, tag, weeks=None) -> DataFrame:
    """Stored class shares. Prunes partitions."""
    return _by_window(spark, root, tag, weeks, SHARE_SCHEMA)


def read_weekly_states(spark, root) -> DataFrame:
    """Stored weekly states; prunes partitions by ISO year and week."""
    return _read(spark, root, WEEK_STATE_SCHEMA)


def read_timeseries(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";") -> DataFrame:
    """Delimited result files with a known column order."""
    return spark.read.csv(path, schema=schema, sep=sep)
