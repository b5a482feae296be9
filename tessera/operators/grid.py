"""Rank laboratory types and lay the chosen ones out on a fixed grid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from tessera.constants import IMAGE_SHAPE, VIDEO_SHAPE
from tessera.functions.values import grid_col, grid_row

LAYOUT_COLUMNS = ("index", "row", "col", "itemid", "label", "category")


def top_labs(events: DataFrame, n: int, *, exclude: Iterable[int] = (), linked_only: bool = False,
             cohort: DataFrame | None = None) -> DataFrame:
    """``(itemid, n_events, rank)`` of the ``n`` most frequent laboratory types.

    Videos use the exclusion list and linked events, images neither.  With a cohort,
    events are counted per admission and type before they meet the cohort, so a hot
    admission shrinks to one row per type.
    """
    usable = events.filter(F.col("itemid").isNotNull())
    excluded = list(exclude)
    if excluded:
        usable = usable.filter(~F.col("itemid").isin(excluded))
    if linked_only or cohort is not None:
        usable = usable.filter(F.col("hadm_id").isNotNull())
    if cohort is None:
        counts = usable.groupBy("itemid").agg(F.count(F.lit(1)).alias("n_events"))
    else:
        counts = (usable.groupBy("hadm_id", "itemid").agg(F.count(F.lit(1)).alias("n"))
                  .join(cohort.select("hadm_id"), "hadm_id", "left_semi")
                  .groupBy("itemid").agg(F.sum("n").alias("n_events")))
    best = counts.orderBy(F.desc("n_events"), "itemid").limit(n)
    # Only the n kept rows reach this window.
    return best.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("n_events"), "itemid")))


def _lay_out(chosen: DataFrame, order: list, shape: tuple[int, int]) -> DataFrame:
    """Number the first H·W rows in order and give them their row-major places."""
    height, width = shape
    kept = chosen.orderBy(*order).limit(height * width)
    index = F.row_number().over(Window.orderBy(*order)) - 1
    return kept.withColumn("index", index).select(
        "index", grid_row(F.col("index"), width).alias("row"),
        grid_col(F.col("index"), width).alias("col"), "itemid", "label", "category")


def _by_category() -> list:
    return [F.col("category").asc_nulls_last(), F.col("itemid").asc()]


def layout_for(ranked: DataFrame, vocabulary: DataFrame, shape: tuple[int, int] = VIDEO_SHAPE, *,
               by_category: bool = True, best_ranks: bool = False) -> DataFrame:
    """Layout of ranked types that the vocabulary knows, by category or by rank.

    Types missing from the vocabulary are left out, so the grid's end may stay empty.  Of more
    types than the grid has places the first in that order get one, as published, or with
    ``best_ranks`` the most frequent; :func:`left_out` lists the others.
    """
    chosen = vocabulary.join(F.broadcast(ranked.select("itemid", "rank")), "itemid")
    if best_ranks:
        chosen = chosen.orderBy("rank").limit(shape[0] * shape[1])
    return _lay_out(chosen, _by_category() if by_category else [F.col("rank")], shape)


def layout_of_vocabulary(vocabulary: DataFrame, shape: tuple[int, int] = IMAGE_SHAPE, *,
                         by_category: bool = True) -> DataFrame:
    """Layout of the vocabulary's first H·W types, without looking at events."""
    known = vocabulary.filter(F.col("itemid").isNotNull())
    return _lay_out(known, _by_category() if by_category else [F.col("itemid")], shape)


def missing_from_vocabulary(ranked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Chosen types that the layout had to leave out."""
    return ranked.join(vocabulary.select("itemid"), "itemid", "left_anti")


def left_out(ranked: DataFrame, layout: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(itemid, n_events, rank, reason)`` of chosen types that have no place in the layout."""
    # A layout has H·W rows at most, the ranked types are a top-k list.
    known = ranked.join(vocabulary.select("itemid").distinct().withColumn("_known", F.lit(True)), "itemid", "left")
    return known.join(F.broadcast(layout.select("itemid")), "itemid", "left_anti").select(
        "itemid", "n_events", "rank",
        F.when(F.col("_known"), "no place").otherwise("not in vocabulary").alias("reason"))


def positions(layout: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Every grid place with its type and label; free places say ``(empty)``."""
    height, width = shape
    spark = layout.sparkSession
    places = spark.range(height * width).select(
        F.col("id").cast("int").alias("index"),
        grid_row(F.col("id"), width).alias("row"), grid_col(F.col("id"), width).alias("col"))
    named = layout.select("index", "itemid", "label")
    return places.join(F.broadcast(named), "index", "left").select(
        "index", "row", "col", "itemid",
        F.when(F.col("itemid").isNull(), "(empty)")
        .otherwise(F.coalesce("label", F.concat(F.lit("itemid_"), F.col("itemid").cast("string"))))
        .alias("label"))


def layout_by_category(layout: DataFrame) -> DataFrame:
    """Per category: how many places it has and which types, in layout order."""
    entries = F.array_sort(F.collect_list(F.struct("index", "itemid")))
    return (layout.groupBy(F.coalesce("category", F.lit("(no category)")).alias("category"))
            .agg(F.count(F.lit(1)).alias("n_cells"), F.min("index").alias("first_index"),
                 entries.alias("e"))
            .select("category", "n_cells", "first_index",
                    F.transform("e", lambda x: x["itemid"]).alias("itemids")))

