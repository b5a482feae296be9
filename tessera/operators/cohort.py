"""Choose admissions: specimen limits, in-window ranking, combined filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.constants import WINDOW_HOURS
from tessera.functions.counting import count_with_distincts
from tessera.functions.lookups import join_by_key
from tessera.functions.timing import in_first_hours, in_window


def specimens_per_admission(events: DataFrame, *, at_most: int | None = None,
                            at_least: int | None = None) -> DataFrame:
    """``(hadm_id, n_specimens)`` over the whole stay, with limits on the count."""
    counted = (events.filter(F.col("hadm_id").isNotNull() & F.col("specimen_id").isNotNull())
               .groupBy("hadm_id").agg(F.countDistinct("specimen_id").alias("n_specimens")))
    if at_most is not None:
        counted = counted.filter(F.col("n_specimens") <= at_most)
    if at_least is not None:
        counted = counted.filter(F.col("n_specimens") >= at_least)
    return counted


def subset_overview(subset: DataFrame, events: DataFrame) -> DataFrame:
    """Size and specimen statistics of a subset, and its share of all admissions."""
    # n_specimens is bounded by the limit that made the subset, so the median's
    # value-to-count table is small.
    by_count = subset.groupBy("n_specimens").agg(F.count(F.lit(1)).alias("n"))
    total = (events.filter(F.col("hadm_id").isNotNull())
             .agg(F.countDistinct("hadm_id").alias("n")).scalar())
    return by_count.agg(
        F.sum("n").alias("n_admissions"),
        (F.sum(F.col("n_specimens") * F.col("n")) / F.sum("n")).alias("mean_specimens"),
        F.percentile("n_specimens", F.lit(0.5), F.col("n")).alias("median_specimens"),
        F.min("n_specimens").alias("min_specimens"),
        F.max("n_specimens").alias("max_specimens"),
    ).withColumn("total_admissions", total).withColumn(
        "pct_of_all", F.lit(100.0) * F.col("n_admissions") / F.col("total_admissions"))


def in_window_ranking(events: DataFrame, *, window_hours: float = WINDOW_HOURS,
                      min_specimens: int | None = None, max_specimens: int | None = None,
                      top: int | None = None, anchor: str = "admittime") -> DataFrame:
    """``(hadm_id, n_events, n_specimens)`` by events inside the window from ``anchor`` on.

    ``top`` keeps the admissions with most events.
    """
    inside = events.filter(F.col("hadm_id").isNotNull() & F.col("specimen_id").isNotNull()
                           & in_window(window_hours, anchor=anchor))
    ranked = inside.groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("specimen_id").alias("n_specimens"))
    if max_specimens is not None:
        ranked = ranked.filter(F.col("n_specimens") <= max_specimens)
    if min_specimens is not None:
        ranked = ranked.filter(F.col("n_specimens") >= min_specimens)
    if top is not None:
        ranked = ranked.orderBy(F.desc("n_events"), "hadm_id").limit(top)
    return ranked


def top_admissions(events: DataFrame, *, top: int = 20, first_hours: int | None = None) -> DataFrame:
    """Admissions with most events, in the whole stay or in its first hours."""
    stay = events.filter(F.col("hadm_id").isNotNull())
    if first_hours is not None:
        stay = stay.filter(in_first_hours(first_hours))
    counted = count_with_distincts(stay, "hadm_id",
                                   {"n_labs": "itemid", "n_specimens": "specimen_id"})
    total = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (counted.orderBy(F.desc("n_events"), "hadm_id").limit(top)
            .withColumn("total_admissions", total))


def combined_cohort(profile: DataFrame, *, min_specimens: int = 16, min_labs: int = 30,
                    min_hours: float = 24.0, max_hours: float = 168.0) -> DataFrame:
    """Admissions of a profile that are long enough, short enough and rich enough."""
    return profile.filter(
        (F.col("n_specimens") >= min_specimens) & (F.col("n_labs") >= min_labs)
        & (F.col("hours") >= min_hours) & (F.col("hours") <= max_hours))


def keep_cohort(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Events of the cohort's admissions."""
    return join_by_key(events, cohort.select("hadm_id"), "hadm_id", "left_semi")
