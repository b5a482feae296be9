"""Events to sparse cells: the last value per admission, time bin and grid place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.functions.lookups import join_by_key
from tessera.functions.ordered import rank_key
from tessera.functions.timing import elapsed_micros, in_bins, in_window, time_bin
from tessera.functions.values import from_number_text, present, present_or_null, reference_scaled
from tessera.operators.link import TIEBREAK

CELL_KEYS = ("hadm_id", "time_bin", "row", "col", "itemid")


def place_events(events: DataFrame, layout: DataFrame, *, n_bins: int, bin_hours: float,
                 cohort: DataFrame | None = None, anchor: str = "admittime") -> DataFrame:
    """Events inside the window and on the grid, with ``time_bin``, ``row`` and ``col``.

    The layout holds at most H·W rows.  ``anchor`` names the column of time zero.
    """
    inside = events.filter(F.col("hadm_id").isNotNull() & in_bins(n_bins, bin_hours, anchor=anchor))
    if cohort is not None:
        inside = join_by_key(inside, cohort.select("hadm_id"), "hadm_id", "left_semi")
    return inside.join(F.broadcast(layout.select("itemid", "row", "col")), "itemid").withColumn(
        "time_bin", time_bin(bin_hours, anchor=anchor)
    ).withColumn("elapsed", elapsed_micros("charttime", anchor))


def window_events(events: DataFrame, layout: DataFrame, *, n_bins: int, bin_hours: float,
                  window_hours: float, anchor: str = "admittime") -> DataFrame:
    """Events inside the window, on the grid or not: as :func:`place_events` with ``in_window``.

    Off the grid, and after the last whole bin, ``time_bin``, ``row`` and ``col`` are null.
    """
    seen, binned = in_window(window_hours, anchor=anchor), in_bins(n_bins, bin_hours, anchor=anchor)
    inside = events.filter(F.col("hadm_id").isNotNull() & (seen | binned))
    placed = inside.join(F.broadcast(layout.select("itemid", "row", "col")), "itemid", "left")
    on_grid = F.col("row").isNotNull() & binned
    return placed.withColumns({
        "time_bin": F.when(on_grid, time_bin(bin_hours, anchor=anchor)), "in_window": seen,
        "elapsed": elapsed_micros("charttime", anchor)})


def last_cells(placed: DataFrame, *, keys: Sequence[str] = CELL_KEYS,
               tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """Last present value per cell as float32; a later null never overwrites.

    Two-phase aggregation: a hot admission is reduced to its cells before the shuffle.
    """
    return (placed.filter(present("valuenum")).groupBy(*keys)
            .agg(F.max_by("valuenum", rank_key(placed, "charttime", tiebreak)).cast("float")
                 .alias("value")))


def mean_cells(placed: DataFrame, *, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Mean instead of last value per cell."""
    return (placed.filter(present("valuenum")).groupBy(*keys)
            .agg(F.avg("valuenum").cast("float").alias("value")))


def count_cells(placed: DataFrame, *, keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Number of present values per cell."""
    return (placed.filter(present("valuenum")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_values")))


def specimen_cells(events: DataFrame, layout: DataFrame, *, scaled: bool = False,
                   specimens: DataFrame | None = None, text_column: str | None = None,
                   tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """``(specimen_id, row, col, itemid, value)``: the last row per place.

    Unlike in videos a later missing value clears an earlier one.  ``scaled`` uses the
    reference range.  All specimens are done in one job; ``specimens`` selects some.
    ``text_column`` takes values from numbers written as text instead of ``valuenum``.
    """
    known = events.filter(F.col("specimen_id").isNotNull())
    if specimens is not None:
        known = join_by_key(known, specimens.select("specimen_id"), "specimen_id", "left_semi")
    number = F.col("valuenum") if text_column is None else from_number_text(text_column)
    value = (reference_scaled(number, F.col("ref_range_lower"), F.col("ref_range_upper"))
             if scaled else present_or_null(number))
    placed = known.join(F.broadcast(layout.select("itemid", "row", "col")), "itemid")
    return (placed.groupBy("specimen_id", "row", "col", "itemid")
            .agg(F.max_by(value, rank_key(placed, "charttime", tiebreak)).cast("float").alias("value"))
            .filter(F.col("value").isNotNull()))
