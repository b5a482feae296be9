"""Exact ranks and percentiles of large groups, spread over many tasks.

``percentile`` keeps every distinct value of a group in one task.  Here the interval that holds
a rank is found first and refined: values fall into intervals of a fixed monotone function, one
aggregate counts them, and counts before an interval give the rank of its first value.  Only the
values of intervals that hold a wanted rank are counted and sorted.  The work per value does not
depend on the number of partitions; a group's tasks see its intervals (some 10^5 for values of
ten orders of magnitude) and one interval's values, never all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.constants import PERCENTS

# Intervals per factor e, and the size below which values lie in few intervals.
_INTERVALS, _SMALL = 1 << 15, 1e-9


def stack(df: DataFrame, metrics: dict[str, Column], *, keep: Sequence[str] = ()) -> DataFrame:
    """Turn columns into ``(keep…, metric, value double)`` rows; null values are left out."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("metric"), col.cast("double").alias("value"))
        for name, col in metrics.items()
    ])
    return (df.select(*keep, F.explode(entries).alias("_m"))
            .select(*keep, "_m.metric", "_m.value").filter(F.col("value").isNotNull()))


def _interval(value: str) -> Column:
    """Number of a value's interval, never falling as values rise: each step of it is monotone, and
    so is rounding.  NaN is the last interval, as it is the largest value."""
    size = F.rint(F.log1p(F.abs(value) / F.lit(_SMALL)) * F.lit(float(_INTERVALS)))
    return F.signum(value) * size


def _before(by: list[str], order: str) -> Column:
    """Values of a group before the current interval or value."""
    rows = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(rows), F.lit(0))


def value_ranks(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``(by…, value, copies, below, n)`` for every distinct value of every group."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", _interval(value))
    offsets = counts.groupBy(*by, "_at").agg(F.sum("_n").alias("_n"))
    offsets = offsets.select(*by, "_at", _before(by, "_at").alias("_offset"),
                             F.sum("_n").over(Window.partitionBy(*by)).alias("n"))
    ranked = counts.withColumn("_inside", _before([*by, "_at"], value))
    return ranked.join(offsets, [*by, "_at"]).select(
        *by, value, F.col("_n").alias("copies"), (F.col("_offset") + F.col("_inside")).alias("below"), "n")


def counted_percentiles(df: DataFrame, by: Sequence[str], value: str = "value",
                        percents: Sequence[float] = PERCENTS) -> DataFrame:
    """As :func:`percentiles` for values of few kinds, such as counts inside a grid.

    Values are counted first, so that a group's task sees each kind once.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct(F.col(value).alias("v"), F.col("_n").alias("n"))
    return counts.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.sort_array(F.collect_list(entry)).alias("_kinds"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).select(*by, "n", "mean", *[_at_rank(q).alias(f"p{q:g}") for q in percents], "min", "max")


def _at_rank(percent: float) -> Column:
    """Linearly interpolated percentile of sorted (value, count) kinds."""
    rank = F.lit(percent / 100.0) * (F.col("n").cast("double") - 1)

    def value_at(r: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("_kinds", start, lambda acc, k: F.struct(
            (acc["below"] + k["n"]).alias("below"),
            F.when(acc["below"] <= r, k["v"]).otherwise(acc["v"]).alias("v")))["v"]

    low, high = value_at(F.floor(rank)), value_at(F.ceil(rank))
    return low + (rank - F.floor(rank)) * (high - low)


def percentiles(df: DataFrame, by: Sequence[str], value: str = "value",
                percents: Sequence[float] = PERCENTS) -> DataFrame:
    """``(by…, n, mean, p<q>…, min, max)``, percentiles linearly interpolated.

    Groups are few (metrics, channels): the intervals that hold their ranks, at most two for each
    percentile of a group, are broadcast.
    """
    by = list(by)
    rows = df.select(*by, value).withColumn("_at", _interval(value))
    counts = rows.groupBy(*by, "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    group = Window.partitionBy(*by)
    counts = counts.select(
        *by, "_at", "_n", _before(by, "_at").alias("_offset"), F.sum("_n").over(group).alias("n"),
        (F.sum("_sum").over(group) / F.sum("_n").over(group)).alias("mean"),
        F.min("_least").over(group).alias("min"), F.max("_most").over(group).alias("max"))
    ranks = {q: F.lit(q / 100.0) * (F.col("n").cast("double") - 1) for q in percents}

    def holds(rank: Column, first: str) -> Column:
        return (F.col(first) <= rank) & (rank < F.col(first) + F.col("_n"))

    wanted = F.lit(False)
    for r in ranks.values():
        wanted = wanted | holds(F.floor(r), "_offset") | holds(F.ceil(r), "_offset")
    about = ("_offset", "n", "mean", "min", "max")
    wanted = F.broadcast(counts.filter(wanted).select(*by, "_at", *about))
    inside = (rows.join(wanted, [*by, "_at"]).groupBy(*by, "_at", value)
              .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in about]))
    # One shuffle for the window and the last aggregate: both keep a group together.
    ranked = inside.repartition(*by).withColumn("_below", F.col("_offset") + _before([*by, "_at"], value))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, "_below"), F.col(value)))

    return ranked.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n", "mean")],
        *[(at(F.floor(r)) + F.max(r - F.floor(r)) * (at(F.ceil(r)) - at(F.floor(r))))
          .alias(f"p{q:g}") for q, r in ranks.items()],
        *[F.max(c).alias(c) for c in ("min", "max")])
