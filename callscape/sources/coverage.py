"""Which weeks a folder of dated files covers, told from the file names alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions.calendar import iso_week, iso_year, parse_timestamp


def files_in_path(
    spark: SparkSession,
    path: str,
    name_regex: str = r"(\d{8})[^/]*$",
    date_pattern: str = "yyyyMMdd",
) -> DataFrame:
    """``path, day, iso_year, iso_week`` of each file whose path carries a date.

    Only the listing is used: the contents column is pruned, so no file is opened.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    )
    text = F.regexp_extract("path", name_regex, 1)
    day = F.to_date(parse_timestamp(text, date_pattern))
    return (
        listing.select("path", day.alias("day"))
        .filter(F.col("day").isNotNull())
        .withColumns({"iso_year": iso_year(F.col("day")), "iso_week": iso_week(F.col("day"))})
    )


def weeks_in_path(
    spark: SparkSession,
    path: str,
    name_regex: str = r"(\d{8})[^/]*$",
    date_pattern: str = "yyyyMMdd",
) -> DataFrame:
    """The distinct ISO weeks of :func:`files_in_path`."""
    return files_in_path(spark, path, name_regex, date_pattern).select("iso_year", "iso_week").distinct()
