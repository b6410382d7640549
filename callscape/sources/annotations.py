"""User annotations: (user, region) -> class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.schema import ANNOTATION_SCHEMA

# Fixed value: the two printed-tuple formats, flat and nested.
TUPLE_PATTERN = r"^\(\(?u?'([^']*)', u?'([^']*)'\)?, u?'([^']*)'\)$"


def parse_annotations(lines: DataFrame) -> DataFrame:
    """Annotations from printed tuples in ``value``; a line of another shape fails the job."""
    fits = F.when(F.col("value").rlike(TUPLE_PATTERN), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not an annotation: "), F.col("value")))
    )
    return lines.filter(fits).select(
        *[
            F.regexp_extract("value", TUPLE_PATTERN, group).alias(name)
            for group, name in enumerate(ANNOTATION_SCHEMA.names, start=1)
        ]
    )


def read_annotations(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Read annotations stored by this package (``parquet``) or printed tuples (``legacy``)."""
    if format == "parquet":
        return spark.read.schema(ANNOTATION_SCHEMA).parquet(path)
    if format == "legacy":
        return parse_annotations(spark.read.text(path))
    raise ValueError(f"unknown format {format!r}")
