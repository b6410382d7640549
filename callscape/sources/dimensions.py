"""Cell-to-region and site-to-zone dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.sources.cdr import WHITESPACE

# Fixed value: characters of a cell name that identify its site.
SITE_LENGTH = 5


def parse_cells(
    lines: DataFrame,
    order: Column,
    key: str = "exact",
    n: int = SITE_LENGTH,
    sep: str = ";",
    on_duplicate: str = "last",
) -> DataFrame:
    """``cell_id, region`` from text lines in ``value``.

    ``key='prefix'`` keeps the first ``n`` characters of the cell. Of several lines for a key
    the last in ``order`` counts, unless ``on_duplicate='fanout'`` keeps them all. A line
    without a region fails the job; blank lines are skipped.
    """
    if key not in ("exact", "prefix") or on_duplicate not in ("last", "fanout"):
        raise ValueError(f"unknown key {key!r} or on_duplicate {on_duplicate!r}")
    parts = F.split(F.col("value"), r"\Q" + sep + r"\E", -1)
    region = F.coalesce(
        F.get(parts, F.lit(1)),
        F.raise_error(F.concat(F.lit("cell line without a region: "), F.col("value"))).cast("string"),
    )
    cell = F.trim(F.get(parts, F.lit(0)), F.lit(WHITESPACE))
    cells = lines.filter(F.trim("value", F.lit(WHITESPACE)) != "").select(
        (F.substring(cell, 1, n) if key == "prefix" else cell).alias("cell_id"),
        F.trim(region, F.lit(WHITESPACE)).alias("region"),
        order.alias("_order"),
    )
    if on_duplicate == "fanout":
        return cells.drop("_order")
    return cells.groupBy("cell_id").agg(F.max_by("region", "_order").alias("region"))


def read_cells(
    spark: SparkSession,
    path: str,
    key: str = "exact",
    n: int = SITE_LENGTH,
    sep: str = ";",
    on_duplicate: str = "last",
) -> DataFrame:
    """Read a ``cell;region`` file.

    The line order used for duplicates is (file, block, position in the block), so it does
    not depend on how the file is split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()
        ).alias("position"),
    )
    return parse_cells(lines, F.col("position"), key, n, sep, on_duplicate)


def read_cell_list(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Distinct cells (``nidt``) of a file with a cell name first on each line."""
    name = F.trim(F.substring_index("value", sep, 1))
    return spark.read.text(path).select(name.alias("nidt")).filter("nidt <> ''").distinct()
