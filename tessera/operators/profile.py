"""Distribution, coverage, density and feasibility reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.constants import (DURATION_BUCKETS, MIN_LABS_STEPS, MIN_SPECIMENS_STEPS, PERCENTS,
                               SWEEP_SIZES)
from tessera.functions.counting import count_with_distincts, distinct_values
from tessera.functions.lookups import join_by_key
from tessera.functions.ordered import nearest_known
from tessera.functions.quantiles import counted_percentiles, percentiles, stack
from tessera.functions.timing import span_hours
from tessera.functions.values import percent
from tessera.operators.grid import top_labs


def dataset_totals(events: DataFrame) -> DataFrame:
    """Rows, distinct admissions and specimens, nulls and their share."""
    n = F.col("n_events")
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("hadm_id").isNull()).alias("hadm_null"),
        F.count_if(F.col("valuenum").isNull()).alias("valuenum_null"),
    ).select(
        "n_events", distinct_values(events, "hadm_id").alias("n_admissions"),
        distinct_values(events, "specimen_id").alias("n_specimens"), "hadm_null", "valuenum_null",
        percent(F.col("hadm_null"), n).alias("hadm_null_pct"),
        percent(F.col("valuenum_null"), n).alias("valuenum_null_pct"))


def specimen_profile(events: DataFrame, *, cells: int = 256) -> DataFrame:
    """Per linked specimen: distinct types, events, share of the grid."""
    return (events.filter(F.col("specimen_id").isNotNull() & F.col("hadm_id").isNotNull())
            .groupBy("specimen_id")
            .agg(F.countDistinct("itemid").alias("n_labs"), F.count(F.lit(1)).alias("n_events"))
            .withColumn("fill_pct", F.lit(100.0) * F.col("n_labs") / F.lit(float(cells))))


def admission_profile(events: DataFrame) -> DataFrame:
    """Per admission: events, distinct types and specimens, hours between first and last."""
    timed = events.filter(F.col("hadm_id").isNotNull() & F.col("charttime").isNotNull())
    counted = count_with_distincts(
        timed, "hadm_id", {"n_labs": "itemid", "n_specimens": "specimen_id"}, time="charttime")
    return counted.select("hadm_id", "n_events", "n_labs", "n_specimens",
                          span_hours(F.col("first_at"), F.col("last_at")).alias("hours"))


def sampling_frequency(profile: DataFrame) -> DataFrame:
    """Specimens per hour, 0 for stays without duration."""
    return profile.withColumn("specimens_per_hour", F.when(
        F.col("hours") > 0, F.col("n_specimens") / F.col("hours")).otherwise(0.0))


def specimen_distributions(profile: DataFrame) -> DataFrame:
    """Distribution summaries of the specimen profile, one row per metric."""
    return percentiles(stack(profile, {
        c: F.col(c) for c in ("n_labs", "n_events", "fill_pct")}), ["metric"])


def admission_distributions(profile: DataFrame) -> DataFrame:
    """Distribution summaries of the admission profile; only positive frequencies count."""
    frequency = F.when(F.col("specimens_per_hour") > 0, F.col("specimens_per_hour"))
    metrics = {c: F.col(c) for c in ("n_events", "n_labs", "n_specimens", "hours")}
    return percentiles(
        stack(sampling_frequency(profile), {**metrics, "specimens_per_hour": frequency}),
        ["metric"])


def specimen_gaps(events: DataFrame) -> DataFrame:
    """Hours between consecutive specimens of an admission.

    The previous specimen is found per slice of even rows, so no admission fills one task.
    """
    times = (events.filter(F.col("hadm_id").isNotNull() & F.col("specimen_id").isNotNull()
                           & F.col("charttime").isNotNull())
             .groupBy("hadm_id", "specimen_id").agg(F.min("charttime").alias("spec_time")))
    previous = nearest_known(times, {"prev_time": "spec_time"}, part="hadm_id", time="spec_time",
                             tiebreak=("specimen_id",), forward=False, include_current=False)
    return previous.filter(F.col("prev_time").isNotNull()).select(
        "hadm_id", "specimen_id",
        span_hours(F.col("prev_time"), F.col("spec_time")).alias("gap_hours"))


def subset_admission_stats(events: DataFrame, subset: DataFrame) -> DataFrame:
    """Admission profile of a subset that carries the subset's specimen count along."""
    timed = events.filter(F.col("hadm_id").isNotNull() & F.col("charttime").isNotNull())
    inside = join_by_key(timed, subset.select("hadm_id"), "hadm_id", "left_semi")
    counted = count_with_distincts(inside, "hadm_id", {"n_labs": "itemid"}, time="charttime")
    return counted.join(subset, "hadm_id").select(
        "hadm_id", "n_events", "n_labs", "n_specimens",
        span_hours(F.col("first_at"), F.col("last_at")).alias("hours"))


def lab_coverage(events: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Per laboratory type: events, admissions, specimens, share of all admissions."""
    linked = events.filter(F.col("hadm_id").isNotNull())
    if subset is not None:
        linked = join_by_key(linked, subset.select("hadm_id"), "hadm_id", "left_semi")
        total = subset.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        total = linked.agg(F.countDistinct("hadm_id").alias("n")).scalar()
    counted = count_with_distincts(linked, "itemid", {"n_admissions": "hadm_id",
                                                      "n_specimens": "specimen_id"})
    return counted.withColumn("admission_pct", F.lit(100.0) * F.col("n_admissions") / total)


def with_labels(per_lab: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Label and category of each type, ``?`` where the vocabulary has none."""
    return per_lab.join(vocabulary.select("itemid", "label", "category"), "itemid", "left").select(
        *[F.col(c) for c in per_lab.columns],
        F.coalesce("label", F.lit("?")).alias("label"),
        F.coalesce("category", F.lit("?")).alias("category"))


def rich_specimens(events: DataFrame, *, top: int = 20, having_tensor: DataFrame | None = None
                   ) -> DataFrame:
    """Specimens with most events, with ``having_tensor`` among those with a stored tensor."""
    counted = (events.filter(F.col("specimen_id").isNotNull()).groupBy("specimen_id")
               .agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("itemid").alias("n_labs")))
    order = [F.desc("n_events"), F.col("specimen_id")]
    if having_tensor is not None:
        counted = join_by_key(counted, having_tensor.select("specimen_id"), "specimen_id", "left_semi")
    return counted.orderBy(*order).limit(top)


def distinct_specimens(events: DataFrame) -> DataFrame:
    """Specimen ids in ascending order."""
    return (events.filter(F.col("specimen_id").isNotNull()).select("specimen_id").distinct()
            .orderBy("specimen_id"))


def _sweep(events: DataFrame, subset: DataFrame, unit: str, sizes: Sequence[int]) -> DataFrame:
    """``(k, labs_in_grid, n_units)`` for all grid sizes in one pass over the events."""
    ranked = top_labs(events, max(sizes), cohort=subset)
    usable = events.filter(F.col("hadm_id").isNotNull() & F.col(unit).isNotNull())
    keys = list(dict.fromkeys(["hadm_id", unit]))
    in_grid = (usable.select(*keys, "itemid")
               .join(F.broadcast(ranked.select("itemid", "rank")), "itemid").distinct())
    seen = (join_by_key(in_grid, subset.select("hadm_id"), "hadm_id", "left_semi")
            .select(unit, "rank").distinct())
    per_unit = seen.groupBy(unit).agg(*[
        F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in sizes])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("labs_in_grid"))
                        for k in sizes])
    return (per_unit.select(F.explode(entries).alias("e")).select("e.*")
            .filter(F.col("labs_in_grid") > 0)
            .groupBy("k", "labs_in_grid").agg(F.count(F.lit(1)).alias("n_units")))


def grid_sweep(events: DataFrame, subset: DataFrame, *, unit: str = "specimen_id",
               sizes: Sequence[int] = SWEEP_SIZES) -> DataFrame:
    """Fill of grids of several sizes per specimen, or coverage per admission.

    A unit's count is at most the grid size, so a percentile group has few values.
    """
    counts = _sweep(events, subset, unit, sizes)
    points = F.array(*[F.lit(p / 100.0) for p in PERCENTS])
    fill = F.lit(100.0) * F.col("labs_in_grid") / F.col("k")
    return counts.groupBy("k").agg(
        F.sum("n_units").alias("n_units"),
        (F.sum(F.col("labs_in_grid") * F.col("n_units")) / F.sum("n_units")).alias("mean_labs"),
        F.percentile("labs_in_grid", F.lit(0.5), F.col("n_units")).alias("median_labs"),
        (F.sum(fill * F.col("n_units")) / F.sum("n_units")).alias("mean_fill"),
        F.percentile(fill, points, F.col("n_units")).alias("p"),
    ).select("k", "n_units", "mean_labs", "median_labs", "mean_fill",
             *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate(PERCENTS)])


def duration_buckets(profile: DataFrame) -> DataFrame:
    """Admissions, median specimens and median types per length of stay, for every bucket."""
    bucket = F.lit(None).cast("string")
    for name, low, high in reversed(DURATION_BUCKETS):
        bucket = F.when((F.col("hours") >= low) & (F.col("hours") < high), name).otherwise(bucket)
    bucketed = profile.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    rows = stack(bucketed, {"specimens": F.col("n_specimens"), "labs": F.col("n_labs")},
                 keep=["bucket"])
    medians = counted_percentiles(rows, ["bucket", "metric"], percents=(50,))
    found = medians.groupBy("bucket").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("metric") == "specimens", F.col("p50"))).alias("median_specimens"),
        F.max(F.when(F.col("metric") == "labs", F.col("p50"))).alias("median_labs"))
    names = F.array(*[F.lit(name) for name, _, _ in DURATION_BUCKETS])
    every = profile.sparkSession.range(1).select(F.explode(names).alias("bucket"))
    return every.join(found, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n_admissions"), "median_specimens", "median_labs")


def feasibility(profile: DataFrame, *, specimens: Sequence[int] = MIN_SPECIMENS_STEPS,
                labs: Sequence[int] = MIN_LABS_STEPS) -> DataFrame:
    """Admissions with at least N specimens or N types, for several N, in one pass."""
    steps = [("n_specimens", n) for n in specimens] + [("n_labs", n) for n in labs]
    counted = profile.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(c) >= n).alias(f"{c}_{n}") for c, n in steps])
    entries = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit(n).alias("at_least"),
                 F.col(f"{c}_{n}").alias("n_admissions")) for c, n in steps])
    return counted.select("total", F.explode(entries).alias("e")).select(
        "e.*", percent(F.col("e.n_admissions"), F.col("total")).alias("pct"))


def histogram(df: DataFrame, value: str, *, bins: int = 50, at_most: float | None = None,
              density: bool = False) -> DataFrame:
    """Equal-width histogram between the smallest and largest value, last bin closed.

    Bins without a value count 0; without any value there are no bins.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if at_most is not None:
        rows = rows.filter(F.col("v") <= at_most)
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"),
                             F.count(F.lit(1)).alias("n")).alias("ends")).scalar()
    # A single repeated value is put in the middle of a range of width 1.
    span = [F.col("e.n").alias("n"), *[
        F.when(F.col("e.lo") == F.col("e.hi"), F.col(f"e.{side}") + shift)
        .otherwise(F.col(f"e.{side}")).alias(side)
        for side, shift in (("lo", -0.5), ("hi", 0.5))]]
    placed = rows.withColumn("e", ends).select("v", *span)
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    filled = placed.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("filled"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("e", ends)
    counted = (every.filter(F.col("e.n") > 0).select("bin", *span).join(filled, "bin", "left")
               .withColumn("count", F.coalesce("filled", F.lit(0))))
    low = F.col("lo") + F.col("bin") * width
    out = counted.select("bin", low.alias("bin_low"), (low + width).alias("bin_high"), "count",
                         (F.col("count") / (F.col("n") * width)).alias("density"))
    return out if density else out.drop("density")


def table_profile(df: DataFrame, *, null_columns: Sequence[str] = (),
                  unique_columns: Sequence[str] = (), step: str = "table") -> DataFrame:
    """Rows, columns, nulls and distinct values of key columns; null is one distinct value.

    Columns the table does not have are passed over.
    """
    nulls = [c for c in null_columns if c in df.columns]
    uniques = [c for c in unique_columns if c in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in dict.fromkeys(nulls + uniques)])
    n = F.col("n_rows")
    return counted.select(
        F.lit(step).alias("step"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        *[F.col(f"{c}_nulls") for c in nulls],
        *[F.coalesce(percent(F.col(f"{c}_nulls"), n), F.lit(0.0)).alias(f"{c}_null_pct")
          for c in nulls],
        *[(distinct_values(df, c) + (F.col(f"{c}_nulls") > 0).cast("int")).alias(f"{c}_unique")
          for c in uniques])
