"""Distinct counts of a table and, several in one pass, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def distinct_values(df: DataFrame, column: str) -> Column:
    """Number of distinct non-null values of a column, as a scalar of its own aggregate.

    Several distinct counts in one aggregate would copy every row once per column.  Apart they
    read one column each, drop repeats in the map task, and a hot value is one row of each task.
    """
    # A countDistinct would be merged with others of its kind again, and then copy rows.
    return df.select(column).distinct().agg(F.count(column)).scalar()


def count_with_distincts(df: DataFrame, key: str, ids: dict[str, str], *,
                         time: str | None = None) -> DataFrame:
    """``(key, n_events, <name>…)`` with the distinct non-null values of each id column.

    Every row is repeated once per id column and counted per ``(key, id)`` first, so a hot
    key is spread by its ids, and all plans that use the counts share one shuffle.  With
    ``time`` its first and last value are added as ``first_at`` and ``last_at``.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("long").alias("id"))
                        for i, c in enumerate(ids.values())])
    at = [] if time is None else [F.col(time).alias("_at")]
    ends = [] if time is None else [F.min("_at").alias("_from"), F.max("_at").alias("_to")]
    per_id = (df.select(key, *at, F.explode(entries).alias("_e"))
              .groupBy(key, F.col("_e.kind").alias("_kind"), F.col("_e.id").alias("_id"))
              .agg(F.count(F.lit(1)).alias("_n"), *ends))
    last = [] if time is None else [F.min("_from").alias("first_at"), F.max("_to").alias("last_at")]
    return per_id.groupBy(key).agg(
        F.sum(F.when(F.col("_kind") == 0, F.col("_n"))).alias("n_events"),
        *[F.count(F.when(F.col("_kind") == i, F.col("_id"))).alias(name)
          for i, name in enumerate(ids)], *last)
