"""Operators put together into the jobs a user runs from files to files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.constants import (BIN_HOURS, CLIP, EXCLUDED_ITEMIDS, IMAGE_SHAPE, LOG_ITEMIDS,
                               VIDEO_SHAPE, WINDOW_HOURS)
from tessera.functions.timing import bin_count
from tessera.functions.values import present_or_null
from tessera.operators import cells, cohort, grid, link, meta, normalize, profile, tensor
from tessera.session import configure, cut_lineage
from tessera.sources import tables, text


def ingest(spark: SparkSession, csv: str, out: str, *, mode: str = "lab") -> None:
    """CSV to typed Parquet; ``mode`` is ``lab`` or ``admissions``."""
    readers = {"lab": text.read_events_csv, "admissions": text.read_admissions_csv}
    tables.write(readers[mode](configure(spark), csv), out)


def link_files(spark: SparkSession, events: str, admissions: str, out: str, *,
               vocabulary: DataFrame | None = None, policy: str = "suffix_last",
               linked_only: bool = False, tiebreak: Sequence[str] = ("labevent_id",)) -> None:
    """Link stored events to stored admissions and write them in subject order."""
    configure(spark)
    linked = link.link_events(tables.read(spark, events), tables.read(spark, admissions),
                              vocabulary=vocabulary, policy=policy, linked_only=linked_only,
                              tiebreak=tiebreak)
    tables.write_linked(linked, out)


@dataclass(frozen=True)
class Videos:
    """The frames of a video run; all lazy."""

    layout: DataFrame
    cohort: DataFrame
    cells: DataFrame
    tensors: DataFrame
    frames: DataFrame
    summary: DataFrame
    placed: DataFrame


def build_videos(events: DataFrame, vocabulary: DataFrame, *,
                 shape: tuple[int, int] = VIDEO_SHAPE, n_labs: int | None = None,
                 window_hours: float = WINDOW_HOURS, bin_hours: float = BIN_HOURS,
                 min_specimens: int | None = None, max_specimens: int | None = None,
                 top: int | None = None, hadm_ids: DataFrame | None = None,
                 exclude: Iterable[int] = (), anchor: str = "admittime",
                 tiebreak: Sequence[str] = ("labevent_id",), keep: bool = False) -> Videos:
    """Linked events to (T, H, W) videos.

    ``max_specimens`` limits whole-stay specimens when types are ranked, and in-window
    specimens when admissions are chosen.  ``hadm_ids`` replaces the choice; ids without
    events give all-missing videos.  An empty ``exclude`` means the standard list.  All frames are
    lazy; with ``keep`` layout, cohort and members are computed once and kept in the folder that
    ``spark.checkpoint.dir`` names.
    """
    kept = cut_lineage if keep else lambda df: df
    n_bins = bin_count(window_hours, bin_hours)
    stay = (cohort.specimens_per_admission(events, at_most=max_specimens)
            if max_specimens is not None else None)
    ranked = grid.top_labs(events, n_labs or shape[0] * shape[1],
                           exclude=list(exclude) or EXCLUDED_ITEMIDS,
                           linked_only=True, cohort=stay)
    # The layout and the cohort are small next to the events and used several times.
    layout = kept(grid.layout_for(ranked, vocabulary, shape))
    chosen = hadm_ids if hadm_ids is not None else kept(cohort.in_window_ranking(
        events, window_hours=window_hours, min_specimens=min_specimens,
        max_specimens=max_specimens, top=top, anchor=anchor))
    placed = cells.place_events(events, layout, n_bins=n_bins, bin_hours=bin_hours,
                                cohort=chosen, anchor=anchor)
    n_cells = shape[0] * shape[1]
    # One pass over the events serves cells, frames and summary.
    folded = kept(meta.members(placed, chosen, n_bins=n_bins, tiebreak=tiebreak))
    last = meta.cells_of(folded)
    return Videos(
        layout=layout, cohort=chosen, cells=last, placed=placed,
        tensors=tensor.video_tensors(last, chosen, (n_bins, *shape)),
        frames=meta.frames_of(folded, n_bins=n_bins, n_cells=n_cells),
        summary=meta.summary_of(folded, n_bins=n_bins, n_cells=n_cells))


def build_images(events: DataFrame, vocabulary: DataFrame, *,
                 shape: tuple[int, int] = IMAGE_SHAPE, top_k: int | None = None,
                 use_top_k: bool = True, by_category: bool = True, scaled: bool = False,
                 specimens: DataFrame | None = None, missing: float | None = float("nan"),
                 tiebreak: Sequence[str] = ("labevent_id",), keep: bool = False) -> DataFrame:
    """Events to one (H, W) image per specimen, all or selected ones, in one job.

    ``keep`` computes the layout once and keeps it, as in :func:`build_videos`.
    """
    if use_top_k:
        ranked = grid.top_labs(events, top_k or shape[0] * shape[1])
        layout = grid.layout_for(ranked, vocabulary, shape, by_category=by_category)
    else:
        layout = grid.layout_of_vocabulary(vocabulary, shape, by_category=by_category)
    ids = profile.distinct_specimens(events)
    if specimens is not None:
        ids = ids.join(specimens.select("specimen_id"), "specimen_id", "left_semi")
    filled = cells.specimen_cells(events, cut_lineage(layout) if keep else layout, scaled=scaled,
                                  specimens=specimens, tiebreak=tiebreak)
    return tensor.specimen_tensors(filled, ids, shape, missing=missing)


def image_files(spark: SparkSession, *, out: str, vocabulary_csv: str, events: str,
                events_csv: str | None = None, admissions: str | None = None,
                linked: str | None = None, **options) -> None:
    """CSV to Parquet, link and specimen images, each step only where it is asked for."""
    configure(spark)
    if events_csv:
        ingest(spark, events_csv, events)
    if admissions and linked:
        link_files(spark, events, admissions, linked)
    source = tables.read_events(spark, linked=linked, raw=events)
    vocabulary = text.read_vocabulary_csv(spark, vocabulary_csv)
    tables.write_tensors(build_images(source, vocabulary, **options), out)


def normalise_tensors(tensors: DataFrame, layout: DataFrame, *, shape: tuple[int, int],
                      stats: DataFrame | None = None, train: DataFrame | None = None,
                      log_itemids: Iterable[int] = LOG_ITEMIDS,
                      limits: tuple[float, float] = CLIP, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored videos to normalised videos, with the statistics used.

    Statistics come from ``stats``, or are fitted on the ``train`` ids, or on all videos; with ``keep``
    they are fitted at once and kept, as in :func:`build_videos`.
    """
    height, width = shape
    per_frame = height * width
    exploded = tensor.explode_tensors(tensors, "hadm_id").filter(F.col("value").isNotNull())
    places = grid.positions(layout, shape)
    at = F.col("position") % per_frame
    sparse = (exploded.withColumn("index", at).join(
        F.broadcast(places.select("index", "row", "col", "itemid")), "index")
        .select("hadm_id", F.floor(F.col("position") / per_frame).cast("int").alias("time_bin"),
                "row", "col", "itemid", present_or_null("value").alias("value")))
    if stats is None:
        fitted_on = (sparse if train is None
                     else cohort.keep_cohort(sparse, train))
        stats = normalize.fit(fitted_on, places, log_itemids=log_itemids)
        stats = cut_lineage(stats) if keep else stats
    z = normalize.transform(sparse, stats, limits=limits).drop("value").withColumnRenamed(
        "z", "value")
    position = F.col("time_bin") * per_frame + F.col("row") * width + F.col("col")
    n_bins = F.element_at("shape", 1)
    dense = tensor.densify_into(z, tensors.select("hadm_id", "shape"), "hadm_id",
                                position.cast("int"), n_bins * per_frame)
    return dense, stats


def step_profiles(steps: dict[str, DataFrame], *, keys: Sequence[str] = (
        "subject_id", "hadm_id", "specimen_id", "itemid", "charttime", "valuenum"),
        sizes: bool = False) -> DataFrame:
    """One row per step, all of one schema: rows, columns and their names, nulls of key columns.

    ``sizes`` adds files and megabytes of tables that were read from files.
    """
    parts = []
    for name, df in steps.items():
        held = [c for c in keys if c in df.columns]
        nulls = F.map_from_arrays(
            F.array(*[F.lit(c) for c in held]).cast("array<string>"),
            F.array(*[F.count_if(F.col(c).isNull()) for c in held]).cast("array<bigint>"))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("nulls")).select(
            F.lit(name).alias("step"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.array(*[F.lit(c) for c in df.columns]).alias("column_names"), "nulls")
        if sizes:
            on_disk = tables.dataset_size(df)
            for c in ("n_files", "size_mb"):
                row = row.withColumn(c, on_disk.select(c).scalar())
        parts.append(row)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def step_profile(*, events: DataFrame | None = None, admissions: DataFrame | None = None,
                 linked: DataFrame | None = None, images: DataFrame | None = None
                 ) -> dict[str, DataFrame]:
    """Profile of every stored artefact that is given, one small table each."""
    keys = ("subject_id", "hadm_id", "specimen_id", "itemid", "charttime", "valuenum")
    out = {}
    if events is not None:
        out["lab_parquet"] = profile.table_profile(
            events, null_columns=keys, step="lab_parquet")
    if admissions is not None:
        out["admissions_parquet"] = profile.table_profile(
            admissions, null_columns=admissions.columns,
            unique_columns=("subject_id", "hadm_id"), step="admissions_parquet")
    if linked is not None:
        out["lab_with_adm"] = profile.table_profile(
            linked, null_columns=("hadm_id", "specimen_id", "admittime"),
            unique_columns=("subject_id", "hadm_id", "specimen_id"), step="lab_with_adm")
    if images is not None:
        out["lab_images"] = tensor.tensor_overview(images).withColumn("step", F.lit("lab_images"))
    return out
