"""Derived views of cells: masks, staleness, carried values, sliding windows, splits."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.lookups import join_by_key
from tessera.functions.ordered import rank_key
from tessera.functions.timing import MICROS_PER_HOUR, after_anchor, elapsed_micros
from tessera.functions.values import percent, present
from tessera.operators.link import TIEBREAK


def completeness(summary: DataFrame, *, at_least: float = 0.6) -> DataFrame:
    """Videos whose share of filled cells reaches the threshold."""
    return (summary.withColumn("completeness", F.col("filled_cells") / F.col("total_cells"))
            .filter(F.col("completeness") >= at_least))


def sliding_windows(events: DataFrame, layout: DataFrame, *, window_hours: int, stride_hours: int,
                    bin_hours: float) -> DataFrame:
    """Events placed once per window they fall into: ``window_start`` and ``time_bin`` in it.

    Windows start every ``stride_hours`` from admission, so an event is repeated
    ⌈window / stride⌉ times at most.
    """
    stride, window = F.lit(stride_hours), F.lit(window_hours)
    hours = F.col("elapsed") / F.lit(MICROS_PER_HOUR)
    first = F.greatest(F.floor((hours - window) / stride) + 1, F.lit(0))
    inside = (events.filter(F.col("hadm_id").isNotNull() & after_anchor())
              .join(F.broadcast(layout.select("itemid", "row", "col")), "itemid")
              .withColumn("elapsed", elapsed_micros("charttime", "admittime")))
    last = F.floor(hours / stride)
    # Between windows, with a stride above the window, an event falls into none.
    inside = inside.filter(first <= last)
    repeated = inside.withColumn("_k", F.explode(F.sequence(first, last))).withColumn(
        "window_start", (F.col("_k") * stride).cast("int")).drop("_k")
    since = F.col("elapsed") - F.col("window_start") * F.lit(MICROS_PER_HOUR)
    return repeated.withColumn(
        "time_bin", F.floor(since / F.lit(bin_hours * MICROS_PER_HOUR)).cast("int"))


def sliding_cells(events: DataFrame, layout: DataFrame, *, window_hours: int, stride_hours: int,
                  bin_hours: float, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """``(hadm_id, window_start, time_bin, row, col, itemid, value)``: the last present value per
    window, bin and place, windows as in :func:`sliding_windows`.

    Windows share their events.  Starts, bins and ends of all windows fall on borders of panes as
    long as the greatest common divisor of stride, bin and window: the last value of each pane is
    found once, and only panes are repeated, once per window that they lie in.
    """
    stride, length, width = (round(h * MICROS_PER_HOUR) for h in (stride_hours, window_hours, bin_hours))
    pane = gcd(stride, length, width)
    inside = (events.filter(F.col("hadm_id").isNotNull() & after_anchor() & present("valuenum"))
              .join(F.broadcast(layout.select("itemid", "row", "col")), "itemid"))
    number = F.floor(elapsed_micros("charttime", "admittime") / F.lit(pane))
    order = rank_key(inside, "charttime", tiebreak)
    keys = ["hadm_id", "row", "col", "itemid"]
    # Between windows, with a stride above the window, a pane lies in none.
    first, last = (F.greatest(F.floor((F.col("_start") - length) / F.lit(stride)) + 1, F.lit(0)),
                   F.floor(F.col("_start") / F.lit(stride)))
    panes = (inside.groupBy(*keys, (number * F.lit(pane)).alias("_start"))
             .agg(F.max_by("valuenum", order).alias("_value"), F.max(order).alias("_order")).filter(first <= last))
    repeated = panes.withColumn("_k", F.explode(F.sequence(first, last)))
    since = F.col("_start") - F.col("_k") * F.lit(stride)
    return (repeated.withColumn("window_start", (F.col("_k") * F.lit(stride_hours)).cast("int"))
            .withColumn("time_bin", F.floor(since / F.lit(width)).cast("int"))
            .groupBy("hadm_id", "window_start", "time_bin", "row", "col", "itemid")
            .agg(F.max_by("_value", "_order").cast("float").alias("value")))


def _until_next(cells: DataFrame, n_bins: int) -> DataFrame:
    """Repeat each cell over the bins up to the next observation of its channel."""
    channel = Window.partitionBy("hadm_id", "row", "col").orderBy("time_bin")
    following = F.coalesce(F.lead("time_bin").over(channel), F.lit(n_bins))
    return (cells.withColumn("_next", following)
            .withColumn("bin", F.explode(F.sequence(F.col("time_bin"), F.col("_next") - 1)))
            .drop("_next"))


def carried_forward(cells: DataFrame, *, n_bins: int) -> DataFrame:
    """Last observation carried forward, with its age in bins.

    A channel of one admission has at most T cells, so its window is small.
    """
    return _until_next(cells, n_bins).select(
        "hadm_id", F.col("bin").alias("time_bin"), "row", "col", "value",
        (F.col("bin") - F.col("time_bin")).alias("staleness"))


def time_since_last(cells: DataFrame, *, n_bins: int, bin_hours: float) -> DataFrame:
    """Hours since a channel was last observed, from its first observation on."""
    return _until_next(cells, n_bins).select(
        "hadm_id", F.col("bin").alias("time_bin"), "row", "col",
        ((F.col("bin") - F.col("time_bin")) * F.lit(float(bin_hours))).alias("hours_since"))


def split_by_subject(df: DataFrame, *, buckets: int = 10, validation: Sequence[int] = (8,),
                     test: Sequence[int] = (9,), seed: int | None = 0) -> DataFrame:
    """Add ``split``: all rows of a subject fall on the same side.

    Subjects are dealt by a seeded hash, or with ``seed=None`` by the remainder of their id,
    which is even only for ids without structure.
    """
    dealt = F.col("subject_id") if seed is None else F.xxhash64(F.lit(seed), "subject_id")
    bucket = F.pmod(dealt, F.lit(buckets))
    return df.withColumn("split", F.when(bucket.isin(list(test)), "test")
                         .when(bucket.isin(list(validation)), "validation").otherwise("train"))


def leave_site_out(df: DataFrame, site_col: str, site) -> tuple[DataFrame, DataFrame]:
    """All other sites for fitting, one site for testing."""
    held_out = F.col(site_col) == F.lit(site)
    return df.filter(~held_out), df.filter(held_out)


def site_folds(df: DataFrame, site_col: str) -> DataFrame:
    """Rows on either side for every choice of the held-out site."""
    per_site = df.groupBy(site_col).agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (per_site.withColumn("n_train", total - F.col("n_test"))
            .withColumn("pct_test", percent(F.col("n_test"), F.col("n_test") + F.col("n_train"))))


def harmonise(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Local types and units to shared concepts: ``concept = value · factor + offset``.

    ``mapping`` has one row per local ``itemid``; unmapped events are left out.
    """
    mapped = join_by_key(events, mapping.select("itemid", "concept_id", "factor", "shift"), "itemid")
    return mapped.select(
        *[F.col(c) for c in events.columns if c not in ("itemid", "valuenum")],
        F.col("concept_id").alias("itemid"),
        (F.col("valuenum") * F.col("factor") + F.col("shift")).alias("valuenum"))


def shared_concepts(*datasets: DataFrame) -> DataFrame:
    """Types that occur in every dataset."""
    first, *rest = [d.filter(F.col("itemid").isNotNull()).select("itemid").distinct()
                    for d in datasets]
    for other in rest:
        first = first.join(other, "itemid", "left_semi")
    return first
