"""Peak detection from calls to peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.operators import peaks as P
from callscape.scale import cut_lineage, lookup_join


def peak_ratios(
    calls: DataFrame,
    cells: DataFrame | None = None,
    base_days: tuple[int, int] = P.BASE_DAYS,
    from_doy: int = P.FROM_DAY,
    n_cells: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Filter the data, compute the distributions and compare them.

    All cells are studied, or those in ``cells`` (column ``nidt``), or the first ``n_cells`` in
    order; all days, or those from ``start`` to ``end``. The calls are scanned once: their counts
    (cells x hours x days) are stored and feed the base, the analysed days and both totals.
    """
    calls = P.during(calls, start, end)
    if cells is not None:
        wanted = cells.select(F.col("nidt").alias("id")).distinct()
        calls = lookup_join(calls, wanted, "id")
    counts = cut_lineage(P.call_counts(calls))
    first = None if n_cells is None or cells is not None else P.study_cells(counts, n_cells)
    base = P.peak_base(counts, first, base_days)
    return P.peak_ratio(P.peak_analysis(counts, first, from_doy), base)


def detect_peaks(
    calls: DataFrame,
    cells: DataFrame | None = None,
    base_days: tuple[int, int] = P.BASE_DAYS,
    from_doy: int = P.FROM_DAY,
    n_cells: int | None = None,
    start: str | None = None,
    end: str | None = None,
    **thresholds,
) -> DataFrame:
    """:func:`peak_ratios` followed by the peak filter."""
    return P.peaks(
        peak_ratios(calls, cells, base_days, from_doy, n_cells, start, end), **thresholds)
