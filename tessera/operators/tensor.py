"""Sparse cells to dense arrays and back."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.values import grid_col, grid_row


def video_position(shape: tuple[int, int, int]) -> Column:
    """Place of a cell in the flattened (T, H, W) array, last axis fastest."""
    _, height, width = shape
    return (F.col("time_bin") * (height * width) + F.col("row") * width + F.col("col")).cast("int")


def image_position(shape: tuple[int, int]) -> Column:
    return (F.col("row") * shape[1] + F.col("col")).cast("int")


def densify_into(cells: DataFrame, ids: DataFrame | None, id_col: str, position: Column,
                 size: Column | int, *, missing: float | None = float("nan")) -> DataFrame:
    """``(id…, values array<float>)`` with ``missing`` where there is no cell.

    An id has at most one cell per place, so the collected list is bounded by the shape.
    The array is written front to back, each value followed by the gap to the next one.
    ``ids`` adds ids without any cell, and its other columns.
    """
    size = F.lit(size) if isinstance(size, int) else size
    hole = F.lit(missing).cast("float")
    packed = cells.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(position.alias("at"), F.col("value")))).alias("cells"))
    if ids is not None:
        packed = ids.join(packed, id_col, "left")
    # Place of the following cell, the end of the array after the last one.
    ends = F.concat(
        F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c["at"]),
        F.array(size.cast("int")))
    pieces = F.zip_with("cells", ends, lambda c, end: F.concat(
        F.array(c["value"]), F.array_repeat(hole, end - c["at"] - 1)))
    dense = F.concat(F.array_repeat(hole, F.element_at("cells", 1)["at"]), F.flatten(pieces))
    values = F.when(F.col("cells").isNull(), F.array_repeat(hole, size.cast("int"))).otherwise(dense)
    return packed.withColumn("values", values).drop("cells")


def densify(cells: DataFrame, ids: DataFrame | None, id_col: str, position: Column,
            shape: tuple[int, ...], *, missing: float | None = float("nan")) -> DataFrame:
    """``(id, shape, values)`` of one fixed shape; see :func:`densify_into`."""
    ids = ids.select(id_col) if ids is not None else None
    filled = densify_into(cells, ids, id_col, position, prod(shape), missing=missing)
    return filled.select(id_col, F.array(*[F.lit(int(n)) for n in shape]).alias("shape"), "values")


def video_tensors(cells: DataFrame, cohort: DataFrame | None, shape: tuple[int, int, int], *,
                  missing: float | None = float("nan")) -> DataFrame:
    """One (T, H, W) array per admission, all-missing for cohort members without cells."""
    return densify(cells, cohort, "hadm_id", video_position(shape), shape, missing=missing)


def specimen_tensors(cells: DataFrame, specimens: DataFrame | None, shape: tuple[int, int], *,
                     missing: float | None = float("nan")) -> DataFrame:
    """One (H, W) array per specimen."""
    return densify(cells, specimens, "specimen_id", image_position(shape), shape, missing=missing)


def explode_tensors(tensors: DataFrame, id_col: str) -> DataFrame:
    """``(id, position, value)`` for every place; NaN comes back as null."""
    return tensors.select(id_col, F.posexplode("values").alias("position", "v")).select(
        id_col, "position", F.when(~F.isnan("v"), F.col("v")).alias("value"))


def labelled_cells(tensors: DataFrame, id_col: str, positions: DataFrame, width: int, *,
                   all_cells: bool = False) -> DataFrame:
    """Image arrays back to labelled cells; filled ones unless ``all_cells``."""
    cells = explode_tensors(tensors, id_col)
    if not all_cells:
        cells = cells.filter(F.col("value").isNotNull())
    cells = cells.withColumn("index", F.col("position")).select(
        id_col, "index", grid_row(F.col("index"), width).alias("row"),
        grid_col(F.col("index"), width).alias("col"), "value")
    names = positions.select("index", "itemid", "label")
    return cells.join(F.broadcast(names), "index", "left").select(
        id_col, "row", "col", F.coalesce("itemid", F.lit(0)).alias("itemid"), "label", "value")


def observation_mask(tensors: DataFrame) -> DataFrame:
    """Boolean array of the same layout: True where a value was observed."""
    return tensors.withColumn(
        "mask", F.transform("values", lambda v: v.isNotNull() & ~F.isnan(v))).drop("values")


def tensor_overview(tensors: DataFrame) -> DataFrame:
    """Number of tensors, number of shapes, and whether all shapes agree."""
    per_shape = tensors.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    return per_shape.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tensors"),
        F.count(F.lit(1)).alias("n_shapes"),
        F.min("shape").alias("first_shape"),
        ((F.count(F.lit(1)) <= 1) & (F.coalesce(F.sum("n"), F.lit(0)) > 0)).alias("all_same_shape"))


def tensor_profile(tensors: DataFrame, id_col: str) -> DataFrame:
    """Per tensor: places, filled places, smallest and largest value."""
    seen = F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v))
    return tensors.select(
        id_col, F.size("values").alias("n_cells"), F.size(seen).alias("n_filled"),
        F.array_min(seen).alias("value_min"), F.array_max(seen).alias("value_max"))
