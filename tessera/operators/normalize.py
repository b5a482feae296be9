"""Per-channel normalisation: selective log, z-score, clip; fitted and applied."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tessera.constants import CLIP, LOG_ITEMIDS, MIN_STD
from tessera.functions.quantiles import percentiles, value_ranks
from tessera.functions.values import clip, half_even, log_flag, log_where, present_or_null

CHANNEL = ("row", "col")


def _logged(cells: DataFrame, log_itemids: Iterable[int]) -> DataFrame:
    value = present_or_null(F.col("value").cast("double"))
    return cells.withColumn("x", log_where(value, log_flag(F.col("itemid"), log_itemids)))


def fit(cells: DataFrame, positions: DataFrame, *, log_itemids: Iterable[int] = LOG_ITEMIDS
        ) -> DataFrame:
    """``(row, col, itemid, label, log_transform, mean, std, count)`` for every grid place.

    Sample standard deviation; 1 where there are fewer than two values or no spread.
    Places without values get mean 0 and std 1.
    """
    log_itemids = list(log_itemids)
    seen = (_logged(cells, log_itemids).filter(F.col("x").isNotNull()).groupBy(*CHANNEL)
            .agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"),
                 F.count(F.lit(1)).alias("n")))
    # At most H·W rows on either side.
    return positions.join(F.broadcast(seen), list(CHANNEL), "left").select(
        *CHANNEL, "itemid", F.when(F.col("itemid").isNull(), "?").otherwise(F.col("label"))
        .alias("label"), log_flag(F.col("itemid"), log_itemids).alias("log_transform"),
        F.coalesce("m", F.lit(0.0)).alias("mean"),
        F.coalesce(F.when(F.col("s") >= MIN_STD, F.col("s")), F.lit(1.0)).alias("std"),
        F.coalesce("n", F.lit(0)).alias("count"))


def transform(cells: DataFrame, stats: DataFrame, *, limits: tuple[float, float] = CLIP
              ) -> DataFrame:
    """Cells with the normalised ``z`` (float32); cells without one are left out."""
    params = stats.select(*CHANNEL, "log_transform", "mean", "std")
    x = log_where(present_or_null(F.col("value").cast("double")), F.col("log_transform"))
    z = clip((x - F.col("mean")) / F.col("std"), *limits)
    return (cells.join(F.broadcast(params), list(CHANNEL))
            .withColumn("z", z.cast("float")).drop("log_transform", "mean", "std")
            .filter(F.col("z").isNotNull()))


def report(stats: DataFrame, *, limits: tuple[float, float] = CLIP) -> DataFrame:
    """One nested record of all channels with rounded statistics; H·W entries."""
    lab = F.struct("row", "col", "itemid", "label", "log_transform",
                   half_even(F.col("mean"), 6).alias("mean"),
                   half_even(F.col("std"), 6).alias("std"), "count")
    return stats.agg(
        F.count(F.lit(1)).alias("n_labs"),
        F.count_if("log_transform").alias("n_log_transformed"),
        F.array_sort(F.collect_list(lab)).alias("labs"),
    ).select(F.array(*[F.lit(x) for x in limits]).alias("clip_range"),
             "n_labs", "n_log_transformed", "labs")


def clip_counters(normalised: DataFrame, *, limits: tuple[float, float] = CLIP) -> DataFrame:
    """How many values lie on either clip limit."""
    low, high = limits
    counted = normalised.agg(
        F.count("z").alias("n_valid"), F.count_if(F.col("z") == low).alias("n_low"),
        F.count_if(F.col("z") == high).alias("n_high"))
    n = F.nullif(F.col("n_valid"), F.lit(0))
    rest = F.col("n_valid") - F.col("n_low") - F.col("n_high")
    return counted.select(
        "n_valid", "n_low", "n_high", rest.alias("n_unclipped"),
        (F.lit(100.0) * F.col("n_low") / n).alias("pct_low"),
        (F.lit(100.0) * F.col("n_high") / n).alias("pct_high"),
        (F.lit(100.0) * rest / n).alias("pct_unclipped"))


def extreme_fraction(normalised: DataFrame, *, beyond: float = 3.0) -> DataFrame:
    """Per video: percentage of values with |z| beyond the bound."""
    return normalised.groupBy("hadm_id").agg(
        F.count("z").alias("n_values"),
        (F.lit(100.0) * F.count_if(F.abs("z") > beyond) / F.count("z")).alias("pct_extreme"))


def value_bounds(cells: DataFrame, normalised: DataFrame, *, z_bound: float = 5.0) -> DataFrame:
    """Per video: 1st and 99th percentile of raw values, symmetric bound of z.

    A video has at most T·H·W values, so each percentile group is small.
    """
    raw = cells.groupBy("hadm_id").agg(
        F.percentile(F.col("value").cast("double"), F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    z = normalised.groupBy("hadm_id").agg(
        F.percentile(F.abs(F.col("z").cast("double")), 0.99).alias("z99"))
    return raw.join(z, "hadm_id", "left").select(
        "hadm_id", F.col("p")[0].alias("raw_low"), F.col("p")[1].alias("raw_high"),
        F.when(F.col("z99").isNull(), z_bound)
        .otherwise(F.greatest(F.least("z99", F.lit(z_bound)), F.lit(1.0))).alias("z_bound"))


def robust_scaled(cells: DataFrame) -> DataFrame:
    """(x - median) / interquartile range per channel; range 0 counts as 1."""
    channel = percentiles(cells.withColumn("value", F.col("value").cast("double")),
                          CHANNEL, percents=(25, 50, 75))
    spread = F.col("p75") - F.col("p25")
    params = channel.select(*CHANNEL, F.col("p50").alias("median"),
                            F.when(spread > 0, spread).otherwise(1.0).alias("iqr"))
    scaled = (F.col("value").cast("double") - F.col("median")) / F.col("iqr")
    return (cells.join(F.broadcast(params), list(CHANNEL))
            .withColumn("scaled", scaled).drop("median", "iqr"))


def quantile_scaled(cells: DataFrame) -> DataFrame:
    """Rank of each value within its channel, in [0, 1]; equal values share the lowest rank."""
    ranks = value_ranks(cells, CHANNEL).select(
        *CHANNEL, "value",
        F.when(F.col("n") > 1, F.col("below") / (F.col("n") - 1)).otherwise(0.0).alias("quantile"))
    # The hash gives both sides a shuffle of their own, so that a frequent value is split.
    bucket = F.pmod(F.xxhash64(*CHANNEL, "value"), F.lit(1 << 20))
    return (cells.withColumn("_bucket", bucket)
            .join(ranks.withColumn("_bucket", bucket), [*CHANNEL, "value", "_bucket"]).drop("_bucket"))
