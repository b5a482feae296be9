"""What each video contains: per-frame and per-video metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.ordered import rank_key
from tessera.functions.quantiles import counted_percentiles, stack
from tessera.functions.timing import MICROS_PER_HOUR, hour_label
from tessera.functions.values import half_even, present_or_null
from tessera.operators.link import TIEBREAK

MICROS_PER_MINUTE = 60_000_000.0


# Kinds of members: filled or touched places, specimens, times, and the stays of a given cohort.
_CELL, _SPECIMEN, _TIME, _STAY = range(4)
# Bins whose flags fit one whole number.
_FLAGS = 62


def _masks(n_bins: int) -> list[str]:
    if n_bins < 1:
        raise ValueError("n_bins must be 1 at least")
    return [f"mask{j}" for j in range(-(-n_bins // _FLAGS))]


def members(placed: DataFrame, cohort: DataFrame | None = None, *, n_bins: int, times: bool = False,
            tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """What stays hold, in one aggregate that cells, frames, summaries and records share.

    One row per stay and member: a place in a bin with its last value, a specimen with the bins
    it is in as flags, and with ``times`` a time in a bin.  Events of a stay are reduced to these
    before the shuffle.  ``placed`` comes from :func:`place_events` and ``cohort`` names the stays
    that count, or ``placed`` comes from :func:`window_events` and stays with a specimen inside
    the window count.
    """
    masks = _masks(n_bins)
    value, order = present_or_null("valuenum"), rank_key(placed, "charttime", tiebreak)
    on_grid = F.col("row").isNotNull() & F.col("time_bin").isNotNull()
    inside = F.col("in_window") if cohort is None else F.lit(False)

    def entry(kind: int, member, *, bin_=None, row=None, col=None, number=None, at=None, when=None,
              flags: bool = False):
        flag = F.when(on_grid, F.pow(F.lit(2.0), F.col("time_bin") % _FLAGS).cast("long"))
        kept = [F.when(F.floor(F.col("time_bin") / _FLAGS) == j, flag) if flags else F.lit(None).cast("long")
                for j in range(len(masks))]
        return F.struct(
            F.lit(kind).alias("kind"), member.cast("long").alias("id"),
            *[F.lit(None).cast("int").alias(n) if c is None else c.cast("int").alias(n)
              for n, c in (("time_bin", bin_), ("row", row), ("col", col))],
            (F.lit(None).cast("double") if number is None else number.cast("double")).alias("number"),
            (F.lit(None).cast(at_type) if at is None else at).alias("at"),
            (F.lit(None).cast("long") if when is None else when.cast("long")).alias("elapsed"),
            *[c.alias(m) for m, c in zip(masks, kept)], (inside if flags else F.lit(False)).alias("counts"))

    at_type = placed.select(order.alias("o")).schema["o"].dataType
    bin_, specimen = F.col("time_bin"), F.col("specimen_id")
    entries = [
        F.when(on_grid, entry(_CELL, F.col("itemid"), bin_=bin_, row=F.col("row"), col=F.col("col"), number=value,
                              at=F.when(value.isNotNull(), order), when=F.col("elapsed"))),
        F.when(specimen.isNotNull() & (on_grid | inside), entry(_SPECIMEN, specimen, flags=True))]
    if times:
        entries.append(F.when(on_grid, entry(_TIME, F.col("elapsed"), bin_=bin_)))
    keys = ["hadm_id", "kind", "id", "time_bin", "row", "col"]
    folded = (placed.select("hadm_id", F.explode(F.array(*entries)).alias("e")).filter(F.col("e").isNotNull())
              .select("hadm_id", "e.*").groupBy(*keys).agg(
                  F.max_by("number", "at").cast("float").alias("value"), F.min("elapsed").alias("first"),
                  F.max("elapsed").alias("last"), *[F.bit_or(m).alias(m) for m in masks],
                  F.max("counts").alias("counts")))
    if cohort is None:
        return folded
    stays = cohort.select("hadm_id").distinct().select(
        "hadm_id", *[F.lit(v).cast(folded.schema[c].dataType).alias(c) for c, v in zip(
            folded.columns[1:], (_STAY, *[None] * (len(folded.columns) - 3), True))])
    return folded.union(stays)


def cells_of(folded: DataFrame) -> DataFrame:
    """The cells of :func:`last_cells` from the members of stays that count."""
    return folded.filter((F.col("kind") == _CELL) & F.col("value").isNotNull()).select(
        "hadm_id", "time_bin", "row", "col", F.col("id").alias("itemid"), "value")


def _frames(folded: DataFrame, n_bins: int, lists: dict[str, Column] | None = None) -> DataFrame:
    """One row per stay and bin that holds something, and one of bin -1 for stays to be counted."""
    flags = [F.when(F.col(m).bitwiseAND(F.lit(1 << k)) != 0, F.lit(j * _FLAGS + k))
             for j, m in enumerate(_masks(n_bins)) for k in range(min(_FLAGS, n_bins - j * _FLAGS))]
    bins = F.array_compact(F.array(*flags))
    none = F.array(F.lit(-1))
    at = (F.when(F.col("kind") == _SPECIMEN, F.when(F.size(bins) > 0, bins).otherwise(none))
          .when(F.col("kind") == _STAY, none).otherwise(F.array("time_bin")))
    rows = folded.select(*[c for c in folded.columns if c != "time_bin"], F.posexplode(at).alias("nth", "time_bin"))
    specimen = (F.col("kind") == _SPECIMEN) & (F.col("time_bin") >= 0)
    return rows.groupBy("hadm_id", "time_bin").agg(
        F.count("value").alias("n_cells_filled"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        ((F.max("last") - F.min("first")) / F.lit(MICROS_PER_MINUTE)).alias("time_span_minutes"),
        F.count_if(specimen).alias("n_specimens_merged"),
        # A specimen counts for the stay in the first of its bins.
        F.count_if(specimen & (F.col("nth") == 0)).alias("n_new_specimens"),
        F.max("counts").alias("counts"), *[c.alias(name) for name, c in (lists or {}).items()])


def _padded(frames: DataFrame, n_bins: int) -> DataFrame:
    """Every bin of every stay that counts; a stay has at most T + 1 frames before that."""
    held = [c for c in frames.columns if c not in ("hadm_id", "time_bin", "counts")]
    stays = (frames.groupBy("hadm_id").agg(
        F.max("counts").alias("counts"), F.map_from_entries(F.collect_list(F.struct(
            "time_bin", F.struct(*held)))).alias("f")).filter("counts"))
    every = stays.select("hadm_id", "f", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("time_bin"))
    return every.select("hadm_id", "time_bin", F.try_element_at("f", "time_bin").alias("f")).select(
        "hadm_id", "time_bin", "f.*")


def _described(frames: DataFrame, n_cells: int, *more: str) -> DataFrame:
    filled = F.coalesce("n_cells_filled", F.lit(0))
    return frames.select(
        "hadm_id", "time_bin", filled.alias("n_cells_filled"),
        half_even(F.lit(100.0) * filled / n_cells, 1).alias("fill_pct"),
        F.coalesce("n_specimens_merged", F.lit(0)).alias("n_specimens_merged"),
        F.coalesce("time_span_minutes", F.lit(0.0)).alias("time_span_minutes"),
        "value_min", "value_max", *more)


def frames_of(folded: DataFrame, *, n_bins: int, n_cells: int) -> DataFrame:
    """Per admission and bin: filled cells, merged specimens, time span, value range.

    Events without a value count for specimens and times but fill no cell.
    """
    return _described(_padded(_frames(folded, n_bins), n_bins), n_cells)


def frame_metadata(placed: DataFrame, cohort: DataFrame, *, n_bins: int, n_cells: int,
                   tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """:func:`frames_of` of placed events and a cohort."""
    return frames_of(members(placed, cohort, n_bins=n_bins, tiebreak=tiebreak), n_bins=n_bins, n_cells=n_cells)


def frame_members(placed: DataFrame) -> DataFrame:
    """Long table ``(hadm_id, time_bin, kind, member)`` of what a frame merges.

    ``kind`` is ``specimen`` (the id) or ``time`` (microseconds since time zero).  It holds
    what the nested record lists, however long a stay is.
    """
    entries = F.array(
        F.struct(F.lit("specimen").alias("kind"), F.col("specimen_id").cast("long").alias("member")),
        F.struct(F.lit("time").alias("kind"), F.col("elapsed").cast("long").alias("member")))
    return (placed.select("hadm_id", "time_bin", F.explode(entries).alias("e"))
            .select("hadm_id", "time_bin", "e.kind", "e.member")
            .filter(F.col("member").isNotNull()).distinct())


def summary_of(folded: DataFrame, *, n_bins: int, n_cells: int) -> DataFrame:
    """Per admission: filled cells and frames, fill and density, distinct specimens."""
    total = n_bins * n_cells
    stays = _frames(folded, n_bins).groupBy("hadm_id").agg(
        F.sum("n_cells_filled").alias("filled"), F.count_if(F.col("n_cells_filled") > 0).alias("frames"),
        F.sum("n_new_specimens").alias("specimens"), F.max("counts").alias("counts")).filter("counts")
    return stays.select(
        "hadm_id", F.lit(total).cast("long").alias("total_cells"), F.col("filled").alias("filled_cells"),
        half_even(F.lit(100.0) * F.col("filled") / total, 2).alias("fill_pct"),
        F.col("frames").alias("frames_with_data"), (F.lit(n_bins) - F.col("frames")).alias("frames_empty"),
        half_even(F.lit(100.0) * F.col("frames") / n_bins, 1).alias("temporal_density_pct"),
        F.col("specimens").alias("total_specimens_merged"))


def video_summary(placed: DataFrame, cohort: DataFrame, *, n_bins: int, n_cells: int,
                  tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """:func:`summary_of` of placed events and a cohort."""
    return summary_of(members(placed, cohort, n_bins=n_bins, tiebreak=tiebreak), n_bins=n_bins, n_cells=n_cells)


def run_summary(summary: DataFrame) -> DataFrame:
    """Mean and median of fill, density, frames and specimens over all videos."""
    rows = stack(summary, {
        "fill_pct": F.col("fill_pct"), "temporal_density_pct": F.col("temporal_density_pct"),
        "frames_with_data": F.col("frames_with_data"),
        "total_specimens_merged": F.col("total_specimens_merged")})
    # Fill has at most T·H·W + 1 values, the others fewer: counts per value are small.
    return counted_percentiles(rows, ["metric"], percents=(50,)).select(
        "metric", "n", "mean", F.col("p50").alias("median"))


def fill_timeline(frames: DataFrame, *, n_bins: int) -> DataFrame:
    """Admission by bin matrix of fill percentages, one column per bin."""
    return frames.groupBy("hadm_id").agg(*[
        F.max(F.when(F.col("time_bin") == t, F.col("fill_pct"))).alias(f"bin_{t}")
        for t in range(n_bins)])


def frame_fill_distribution(frames: DataFrame) -> DataFrame:
    """Distribution of the fill of frames that hold data."""
    rows = stack(frames.filter(F.col("n_cells_filled") > 0), {"fill_pct": F.col("fill_pct")})
    return counted_percentiles(rows, ["metric"])


def active_frames(frames: DataFrame, *, first: int = 12) -> DataFrame:
    """The first frames with data of every video; at most T rows meet in one group."""
    order = Window.partitionBy("hadm_id").orderBy("time_bin")
    return (frames.filter(F.col("n_cells_filled") > 0)
            .withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= first))


def documents_of(folded: DataFrame, layout: DataFrame, *, n_bins: int, bin_hours: float,
                 shape: tuple[int, int]) -> DataFrame:
    """One nested record per admission, for a JSON or Parquet sink.

    ``folded`` are :func:`members` with times.  The lists are collected from members, which are
    distinct, so their length is that of the record's own lists, not of the events behind them.
    """
    n_cells = shape[0] * shape[1]
    names = layout.select(F.col("itemid").cast("long").alias("id"), F.lit(_CELL).alias("kind"), "label",
                          F.col("index"), F.col("itemid"))

    def listed(kind: int, entry) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("time_bin") >= 0), entry)))

    lab = F.when(F.col("value").isNotNull(), F.struct("index", "itemid", "label"))
    frames = _padded(_frames(folded.join(F.broadcast(names), ["kind", "id"], "left"), n_bins, {
        "specimen_ids": listed(_SPECIMEN, F.col("id")), "times": listed(_TIME, F.col("id")),
        "labs": listed(_CELL, lab)}), n_bins)
    full = _described(frames, n_cells, "specimen_ids", "times", "labs", "n_new_specimens")
    no_ids = F.array().cast("array<bigint>")
    frame = F.struct(
        F.col("time_bin").alias("bin"),
        hour_label(F.col("time_bin"), bin_hours).alias("hour_range"),
        F.col("n_cells_filled"), F.col("fill_pct"), F.col("n_specimens_merged"),
        F.coalesce("specimen_ids", no_ids).alias("specimen_ids"),
        F.transform(F.coalesce("times", no_ids),
                    lambda t: half_even(t / F.lit(MICROS_PER_HOUR), 2)).alias("charttimes_hours"),
        half_even(F.col("time_span_minutes"), 1).alias("time_span_minutes"),
        half_even(F.col("value_min").cast("double"), 3).alias("value_min"),
        half_even(F.col("value_max").cast("double"), 3).alias("value_max"),
        F.when(F.size("labs") > 0, F.transform("labs", lambda x: F.struct(
            x["itemid"].alias("itemid"), x["label"].alias("label")))).alias("labs_present"))
    total = n_bins * n_cells
    # The padded frames of a stay come from one row of it, so this shuffles no more.
    stays = full.groupBy("hadm_id").agg(
        F.array_sort(F.collect_list(frame)).alias("frames"), F.sum("n_cells_filled").alias("filled"),
        F.count_if(F.col("n_cells_filled") > 0).alias("with_data"),
        F.coalesce(F.sum("n_new_specimens"), F.lit(0)).alias("specimens"))
    all_ids = F.array_sort(F.array_distinct(F.flatten(
        F.transform("frames", lambda f: f["specimen_ids"]))))
    return stays.select(
        "hadm_id", F.array(F.lit(n_bins), F.lit(shape[0]), F.lit(shape[1])).alias("video_shape"),
        F.lit(float(n_bins * bin_hours)).alias("window_hours"),
        F.lit(float(bin_hours)).alias("bin_hours"), F.lit(n_bins).alias("n_bins"),
        F.struct(F.lit(total).cast("long").alias("total_cells"), F.col("filled").alias("filled_cells"),
                 half_even(F.lit(100.0) * F.col("filled") / total, 2).alias("fill_pct"),
                 F.col("with_data").alias("frames_with_data"), (F.lit(n_bins) - F.col("with_data")).alias("frames_empty"),
                 half_even(F.lit(100.0) * F.col("with_data") / n_bins, 1).alias("temporal_density_pct"),
                 F.col("specimens").alias("total_specimens_merged"), all_ids.alias("specimen_ids")).alias("video_summary"),
        "frames")


def video_documents(placed: DataFrame, layout: DataFrame, cohort: DataFrame, *, n_bins: int, bin_hours: float,
                    shape: tuple[int, int], tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """:func:`documents_of` of placed events and a cohort."""
    folded = members(placed, cohort, n_bins=n_bins, times=True, tiebreak=tiebreak)
    return documents_of(folded, layout, n_bins=n_bins, bin_hours=bin_hours, shape=shape)


def with_documents(tensors: DataFrame, documents: DataFrame) -> DataFrame:
    """Tensors next to their metadata record."""
    return tensors.join(documents, "hadm_id", "left")
