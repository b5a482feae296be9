"""Joins of the event table with tables that have one row per key.

A hot key is cut into several tasks by the skew-join split of adaptive execution.  The
split needs a shuffle of its own on either side of the join; a side that was just
aggregated by the same key brings its partitioning along and would switch the split off.
Joining on the key and a hash of it keeps the result and always gives that shuffle.
Small tables are broadcast by Spark after its own size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _bucket(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*[k.cast("long") for k in keys]), F.lit(1 << 20))


def join_by_key(events: DataFrame, table: DataFrame, keys: str | Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join on whole-number keys, open to the skew split on the ``events`` side."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    bucket = _bucket(*[F.col(k) for k in keys])
    return (events.withColumn("_bucket", bucket)
            .join(table.withColumn("_bucket", bucket), [*keys, "_bucket"], how)
            .drop("_bucket"))


def lookup(events: DataFrame, table: DataFrame, key: str, *, spread_by: Sequence[str]) -> DataFrame:
    """Left join on a nullable whole-number key.

    In a shuffled outer join all null keys fall into one partition.  Here a null key is
    replaced by a hash of the ``spread_by`` columns, and the join condition says that
    such rows match nothing.
    """
    known = F.col(key).isNotNull()
    left = events.withColumn("_known", known).withColumn("_key", F.when(
        known, F.col(key).cast("long")).otherwise(F.xxhash64(*[F.col(c) for c in spread_by])))
    right = (table.filter(known).withColumn("_right", F.col(key).cast("long"))
             .withColumn("_right_bucket", _bucket(F.col("_right"))).drop(key))
    matches = ((F.col("_key") == F.col("_right")) & F.col("_known")
               & (_bucket(F.col("_key")) == F.col("_right_bucket")))
    return left.join(right, matches, "left").drop("_key", "_right", "_right_bucket", "_known")
