"""Delimited series and JSON observations, written by the tasks themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of the delimited results.
PRESENCE_COLUMNS = ["region", "date", "user_class", "n_users"]
OD_COLUMNS = ["destination", "date", "origin", "n_users"]
HOURLY_COLUMNS = ["region", "date", "hour", "n_calls", "cells"]


def _as_text(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.ArrayType):
        return F.array_join(column, " ").alias(field.name)
    return column.cast("string").alias(field.name)


def write_timeseries(df: DataFrame, path: str, columns: list[str], sep: str = ";") -> None:
    """Write the columns in order; lists become space-separated text."""
    text = df.select(*[_as_text(df.schema[name]) for name in columns])
    text.write.mode("overwrite").csv(path, sep=sep)


def write_observations(observations: DataFrame, path: str) -> None:
    """One JSON object per line."""
    observations.write.mode("overwrite").json(path)
