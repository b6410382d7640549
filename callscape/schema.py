"""Column contracts shared by the sources, operators and sinks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Ordinals of the simulated call-record file.
DEFAULT_FIELDS = {
    "user_id": 0,
    "date": 3,
    "time": 4,
    "start_cell": 9,
    "end_cell": 10,
    "cdr_type": 11,
}

# Class names as they appear in labels and results.
RESIDENT = "resident"
DYNAMIC_RESIDENT = "dynamic_resident"
COMMUTER = "commuter"
VISITOR = "visitor"
PASSING_BY = "passing by"
NOT_CLASSIFIED = "not classified"
OUTBOUND = "outbound"

WINDOW_KEYS = ["window_year", "window_week"]

CDR_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("start_cell", T.StringType()),
        T.StructField("end_cell", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("time", T.StringType()),
        T.StructField("cdr_type", T.StringType()),
    ]
)

CELL_SCHEMA = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("user_class", T.StringType()),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("window_year", T.IntegerType()),
        T.StructField("window_week", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("profile", T.ArrayType(T.DoubleType())),
    ]
)

WEEK_STATE_SCHEMA = T.StructType(
    [
        T.StructField("iso_year", T.IntegerType()),
        T.StructField("iso_week", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("mask", T.IntegerType()),
    ]
)

CENTROID_SCHEMA = T.StructType(
    [
        T.StructField("window_year", T.IntegerType()),
        T.StructField("window_week", T.IntegerType()),
        T.StructField("centroid_id", T.IntegerType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
    ]
)

SHARE_SCHEMA = T.StructType(
    [
        T.StructField("window_year", T.IntegerType()),
        T.StructField("window_week", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("user_class", T.StringType()),
        T.StructField("share", T.DoubleType()),
    ]
)

ARCHETYPE_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
    ]
)

PRESENCE_SERIES = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("user_class", T.StringType()),
        T.StructField("n_users", T.LongType()),
    ]
)

OD_SERIES = T.StructType(
    [
        T.StructField("destination", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("n_users", T.LongType()),
    ]
)

HOURLY_SERIES = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("hour", T.StringType()),
        T.StructField("n_calls", T.LongType()),
        T.StructField("cells", T.StringType()),
    ]
)


@dataclass(frozen=True)
class CdrLayout:
    """Where each named field sits in a delimited call record.

    ``user_id``, ``start_cell``, ``date`` and ``time`` must be present; any further name
    becomes a string column of its own.
    """

    fields: Mapping[str, int] = field(default_factory=lambda: dict(DEFAULT_FIELDS))

    def __post_init__(self):
        missing = {"user_id", "start_cell", "date", "time"} - set(self.fields)
        if missing:
            raise ValueError(f"layout lacks {sorted(missing)}")
        if any(ordinal < 0 for ordinal in self.fields.values()):
            raise ValueError("layout ordinals must not be negative")

    @classmethod
    def default(cls) -> CdrLayout:
        return cls()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CdrLayout:
        """Read a ``name,ordinal`` file: one line per field, so it is driver configuration."""
        rows = spark.read.csv(path, schema="name string, ordinal int", ignoreLeadingWhiteSpace=True)
        return cls({row["name"].strip(): row["ordinal"] for row in rows.collect()})
