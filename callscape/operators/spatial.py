"""Sites and regions of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.scale import BROADCAST_MAX_ROWS, lookup_join
from callscape.sources.dimensions import SITE_LENGTH

# Fixed value: site of a cell name that is too short, in strict mode.
INVALID_SITE = "invalid"


def site(cell: Column, n: int = SITE_LENGTH, strict: bool = False) -> Column:
    """First ``n`` characters of a cell. Shorter cells stay whole, or are invalid if strict."""
    prefix = F.substring(cell, 1, n)
    return F.when(F.length(cell) >= n, prefix).otherwise(INVALID_SITE) if strict else prefix


def attach_region(
    cdr: DataFrame,
    cells: DataFrame,
    key: str = "exact",
    n: int = SITE_LENGTH,
    strict_site: bool = False,
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
    prefilter: bool = False,
) -> DataFrame:
    """Keep the records whose start cell belongs to a region, and add ``region``.

    ``key='exact'`` looks up the full cell, ``key='prefix'`` its site. Filter and lookup are
    one join.
    """
    if key not in ("exact", "prefix"):
        raise ValueError(f"unknown key {key!r}")
    cell = F.col("start_cell")
    looked_up = cdr.withColumn("cell_id", cell if key == "exact" else site(cell, n, strict_site))
    wanted = cells.select("cell_id", "region")
    return lookup_join(looked_up, wanted, "cell_id", max_rows=max_broadcast_rows,
                       prefilter=prefilter).drop("cell_id")
