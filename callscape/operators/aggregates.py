"""Aggregations shared by the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, count: str, over: list[str], name: str = "share") -> DataFrame:
    """Each row's part of the total of its group. Meant for aggregated rows."""
    total = F.sum(count).over(Window.partitionBy(*over))
    return df.withColumn(name, F.col(count) / total)


def ordered_mode(
    df: DataFrame, keys: list[str], value: str, order: Column, few_per_key: bool = False
) -> DataFrame:
    """Most frequent ``value`` per key; a tie goes to the value seen first in ``order``.

    Rows are counted inside each task first, so a key with many rows sends one per value and task.
    Where keys have few rows, both aggregations can instead share one exchange by ``keys``.
    """
    rows = df.select(*keys, value, order.alias("_order"))
    return (
        (rows.repartition(*keys) if few_per_key else rows)
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"), F.min("_order").alias("_first"))
        .groupBy(*keys)
        .agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))
    )
