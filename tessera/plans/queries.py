"""Registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.constants import NULL_TOKENS
from tessera.functions.lookups import join_by_key
from tessera.functions.timing import (elapsed_hours, elapsed_micros, epoch_micros, in_bins, in_window,
                                      time_bin)
from tessera.functions.values import from_number_text, reference_scaled, zlog_scaled
from tessera.operators import (cells, cohort, features, grid, link, meta, normalize, profile,
                               tensor)
from tessera.plans import jobs
from tessera.session import configure
from tessera.sources import tables, text, views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

N_CELLS = v.EV_SHAPE[0] * v.EV_SHAPE[1]
VIDEO = (v.EV_BINS, *v.EV_SHAPE)
EV_SUBSET, LI_SUBSET = 26, 4


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def six(column: str | Column, name: str | None = None) -> Column:
    """Six decimals: sums of doubles depend on the order of addition."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col.cast("double"), 6).alias(name or column)


def whole(column: str, name: str | None = None) -> Column:
    return F.col(column).cast("long").alias(name or column)


def micros(column: str, name: str | None = None) -> Column:
    return epoch_micros(column).alias(name or f"{column}_us")


# -- views and shared steps ---------------------------------------------------------------


def ev_ranked(s, d, n: int = N_CELLS) -> DataFrame:
    return grid.top_labs(v.ev_raw(s, d), n, exclude=v.EV_EXCLUDED, linked_only=True)


def ev_layout(s, d) -> DataFrame:
    return grid.layout_for(ev_ranked(s, d), v.voc(s, d), v.EV_SHAPE)


def ev_image_layout(s, d, by_category: bool = True) -> DataFrame:
    ranked = grid.top_labs(v.ev_raw(s, d), N_CELLS)
    return grid.layout_for(ranked, v.voc(s, d), v.EV_SHAPE, by_category=by_category)


def ev_cohort(s, d) -> DataFrame:
    return cohort.in_window_ranking(v.ev(s, d), window_hours=v.EV_WINDOW_HOURS)


def ev_placed(s, d) -> DataFrame:
    return cells.place_events(v.ev(s, d), ev_layout(s, d), n_bins=v.EV_BINS,
                              bin_hours=v.EV_BIN_HOURS)


def ev_cells(s, d) -> DataFrame:
    return cells.last_cells(ev_placed(s, d))


def ev_members(s, d, times: bool = False) -> DataFrame:
    rows = cells.window_events(v.ev(s, d), ev_layout(s, d), n_bins=v.EV_BINS, bin_hours=v.EV_BIN_HOURS,
                               window_hours=v.EV_WINDOW_HOURS)
    return meta.members(rows, n_bins=v.EV_BINS, times=times)


def ev_frames(s, d) -> DataFrame:
    return meta.frames_of(ev_members(s, d), n_bins=v.EV_BINS, n_cells=N_CELLS)


def ev_summary(s, d) -> DataFrame:
    return meta.summary_of(ev_members(s, d), n_bins=v.EV_BINS, n_cells=N_CELLS)


def ev_videos(s, d) -> DataFrame:
    return tensor.video_tensors(ev_cells(s, d), ev_cohort(s, d), VIDEO)


def ev_stats(s, d, sparse: DataFrame) -> DataFrame:
    places = grid.positions(ev_layout(s, d), v.EV_SHAPE)
    return normalize.fit(sparse, places, log_itemids=v.EV_LOGGED)


def ev_normalised(s, d) -> DataFrame:
    sparse = ev_cells(s, d)
    return normalize.transform(sparse, ev_stats(s, d, sparse))


def eb_filled(s, d, policy: str) -> DataFrame:
    return link.fill_admissions(v.eb(s, d), v.eb_admissions(s, d), policy=policy)


def eb_linked(s, d, **options) -> DataFrame:
    return link.link_events(v.eb(s, d), v.eb_admissions(s, d), **options)


def ev_subset(s, d) -> DataFrame:
    return cohort.specimens_per_admission(v.ev_raw(s, d), at_most=EV_SUBSET)


def li_subset(s, d) -> DataFrame:
    return cohort.specimens_per_admission(v.li(s, d), at_most=LI_SUBSET)


def cell_columns(df: DataFrame, *values: Column) -> DataFrame:
    return df.select("hadm_id", "time_bin", "row", "col", *values)


# -- sources ------------------------------------------------------------------------------


@query
def ingest_null_tokens(s, d):
    """Text columns with every null token, as a CSV reader gives them, to typed columns."""
    k = v.k_of_props()
    token = F.try_element_at(F.array(*[F.lit(t) for t in NULL_TOKENS]), k % 10 + 1)
    raw = v.table(s, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(k % 10 < len(NULL_TOKENS), token)
        .otherwise(F.col("user_id").cast("string")).alias("subject_id"),
        F.when(k % 4 == 0, "___").otherwise(F.concat(k.cast("string"), F.lit(".5")))
        .alias("valuenum"),
        F.when(k % 7 == 0, "NA").otherwise(F.col("ts").cast("string")).alias("charttime"))
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("subject_id", T.LongType()),
        T.StructField("valuenum", T.DoubleType()),
        T.StructField("charttime", T.TimestampNTZType())])
    return text.typed(raw, schema).select("event_id", "subject_id", "valuenum",
                                          micros("charttime"))


@query
def specimen_events(s, d):
    """All events of the richest specimen, in event order."""
    events = v.ev(s, d)
    best = profile.rich_specimens(v.ev_raw(s, d), top=1)
    found = events.join(F.broadcast(best.select("specimen_id")), "specimen_id", "left_semi")
    return tables.in_event_order(found).select(
        "specimen_id", "subject_id", micros("charttime"), whole("itemid"), "valuenum",
        "ref_range_lower", "ref_range_upper")


# -- linking ------------------------------------------------------------------------------


@query
def link_left_join(s, d):
    joined = link.attach_admissions(v.eb(s, d), v.eb_admissions(s, d))
    return joined.select("event_id", "hadm_id", micros("admittime"))


@query
def link_with_label(s, d):
    return link.attach_labels(v.eb(s, d), v.voc(s, d)).select("event_id", whole("itemid"),
                                                              "lab_label")


@query
def backfill_admittime(s, d):
    return eb_filled(s, d, "suffix_last").select("event_id", micros("admittime_filled"))


@query
def pre_admission_flag(s, d):
    return eb_filled(s, d, "suffix_last").select(
        "event_id", F.coalesce("before_admit", F.lit(False)).cast("int").alias("before_admit"))


@query
def backfill_hadm(s, d):
    return eb_filled(s, d, "suffix_last").select("event_id", "hadm_id_filled")


@query
def backfill_hadm_next(s, d):
    return eb_filled(s, d, "next").select("event_id", "hadm_id_filled",
                                          micros("admittime_filled"))


@query
def link_events(s, d):
    linked = eb_linked(s, d, vocabulary=v.voc(s, d))
    return linked.select("event_id", "subject_id", "hadm_id", "specimen_id", whole("itemid"),
                         "valuenum", micros("charttime"), micros("admittime"), "lab_label")


@query
def link_linked_only(s, d):
    return eb_linked(s, d, linked_only=True).select("event_id", "hadm_id", micros("admittime"))


# -- windows and bins ---------------------------------------------------------------------


@query
def in_window_events(s, d):
    return v.li(s, d).filter(in_window(v.LI_WINDOW_HOURS)).select(
        "hadm_id", "l_linenumber", "itemid", elapsed_micros("charttime", "admittime")
        .alias("elapsed_us"), elapsed_hours("charttime", "admittime").alias("hours"))


@query
def time_bins(s, d):
    return v.ev(s, d).select("event_id", time_bin(v.EV_BIN_HOURS).alias("time_bin"))


@query
def anchor_offsets(s, d):
    """Offsets from another time zero: the first event of the same laboratory type."""
    events = v.ev_raw(s, d)
    zero = events.groupBy("hadm_id", "itemid").agg(F.min("charttime").alias("anchor"))
    offsets = join_by_key(events, zero, ["hadm_id", "itemid"]).select(
        elapsed_hours("charttime", "anchor").alias("hours"))
    return profile.histogram(offsets, "hours", bins=24).select(
        "bin", six("bin_low"), six("bin_high"), "count")


# -- grid ---------------------------------------------------------------------------------


def _layout_columns(layout):
    return layout.select("index", "row", "col", whole("itemid"), "label", "category")


@query
def top_labs(s, d):
    return grid.top_labs(v.ev_raw(s, d), N_CELLS).select(whole("itemid"), "n_events", whole("rank"))


@query
def top_labs_excluding(s, d):
    return ev_ranked(s, d).select(whole("itemid"), "n_events", whole("rank"))


@query
def top_labs_subset(s, d):
    ranked = grid.top_labs(v.ev_raw(s, d), N_CELLS, exclude=v.EV_EXCLUDED, cohort=ev_subset(s, d))
    return ranked.select(whole("itemid"), "n_events", whole("rank"))


@query
def lab_rank(s, d):
    ranked = grid.top_labs(v.li(s, d), 256, linked_only=True)
    return profile.with_labels(ranked, v.parts(s, d)).select(
        "itemid", "n_events", whole("rank"), "label", "category")


@query
def grid_layout(s, d):
    return _layout_columns(ev_layout(s, d))


@query
def grid_layout_vocab_only(s, d):
    return _layout_columns(grid.layout_of_vocabulary(v.voc(s, d), v.EV_SHAPE))


@query
def grid_layout_by_frequency(s, d):
    return _layout_columns(ev_image_layout(s, d, by_category=False))


@query
def grid_missing_labs(s, d):
    ranked = grid.top_labs(v.ev_raw(s, d), 100, linked_only=True)
    return grid.missing_from_vocabulary(ranked, v.voc(s, d)).select(whole("itemid"), "n_events",
                                                                    whole("rank"))


@query
def grid_left_out(s, d):
    """A grid of four by eight for the hundred most frequent types: who has no place, and why."""
    ranked = grid.top_labs(v.ev_raw(s, d), 100, linked_only=True)
    layout = grid.layout_for(ranked, v.voc(s, d), (4, 8))
    return grid.left_out(ranked, layout, v.voc(s, d)).select(whole("itemid"), "n_events", whole("rank"), "reason")


@query
def grid_by_category(s, d):
    return grid.layout_by_category(ev_layout(s, d)).select(
        "category", "n_cells", "first_index",
        F.array_join(F.transform("itemids", lambda i: i.cast("string")), ",").alias("itemids"))


# -- cohorts ------------------------------------------------------------------------------


@query
def cohort_by_specimens(s, d):
    return cohort.specimens_per_admission(v.li(s, d), at_most=LI_SUBSET, at_least=2)


@query
def cohort_in_window(s, d):
    return cohort.in_window_ranking(v.li(s, d), window_hours=v.LI_WINDOW_HOURS,
                                    min_specimens=2, max_specimens=6)


@query
def cohort_combined(s, d):
    found = cohort.combined_cohort(profile.admission_profile(v.ev_raw(s, d)),
                                   min_hours=24.0, max_hours=690.0)
    return found.select("hadm_id", "n_events", "n_labs", "n_specimens", six("hours"))


@query
def top_admissions(s, d):
    return cohort.top_admissions(v.li(s, d))


@query
def top_admissions_24h(s, d):
    return cohort.top_admissions(v.ev(s, d), first_hours=24)


@query
def subset_overview(s, d):
    out = cohort.subset_overview(li_subset(s, d), v.li(s, d))
    return out.select("n_admissions", six("mean_specimens"),
                      F.col("median_specimens").cast("double").alias("median_specimens"),
                      "min_specimens", "max_specimens", "total_admissions", six("pct_of_all"))


@query
def subset_admission_stats(s, d):
    return profile.subset_admission_stats(v.li(s, d), li_subset(s, d))


# -- cells, tensors, metadata -------------------------------------------------------------


@query
def binned_last_value(s, d):
    return ev_cells(s, d).select("hadm_id", "time_bin", "row", "col", whole("itemid"),
                                 F.col("value").cast("double").alias("value"))


@query
def binned_mean_value(s, d):
    return cell_columns(cells.mean_cells(ev_placed(s, d)),
                        F.col("value").cast("double").alias("value"))


@query
def bin_counts(s, d):
    return cell_columns(cells.count_cells(ev_placed(s, d)), F.col("n_values"))


@query
def video_tensor(s, d):
    return tensor.explode_tensors(ev_videos(s, d), "hadm_id").select(
        "hadm_id", "position", F.col("value").cast("double").alias("value"))


@query
def observation_mask(s, d):
    return tensor.observation_mask(ev_videos(s, d)).select(
        "hadm_id", F.posexplode("mask").alias("position", "m")).select(
        "hadm_id", "position", F.col("m").cast("int").alias("observed"))


@query
def tensor_profile(s, d):
    return tensor.tensor_profile(ev_videos(s, d), "hadm_id").select(
        "hadm_id", "n_cells", "n_filled", F.col("value_min").cast("double").alias("value_min"),
        F.col("value_max").cast("double").alias("value_max"))


@query
def tensor_overview(s, d):
    return tensor.tensor_overview(ev_videos(s, d)).select(
        "n_tensors", "n_shapes", F.col("all_same_shape").cast("int").alias("all_same_shape"))


@query
def frame_metadata(s, d):
    return ev_frames(s, d).select(
        "hadm_id", "time_bin", "n_cells_filled", "fill_pct", "n_specimens_merged",
        six("time_span_minutes"), F.col("value_min").cast("double").alias("value_min"),
        F.col("value_max").cast("double").alias("value_max"))


@query
def frame_documents(s, d):
    """The nested metadata records, one row per frame for comparison."""
    documents = meta.documents_of(ev_members(s, d, times=True), ev_layout(s, d), n_bins=v.EV_BINS,
                                  bin_hours=v.EV_BIN_HOURS, shape=v.EV_SHAPE)
    frame = documents.select("hadm_id", F.size("video_summary.specimen_ids").alias("all_ids"),
                             F.explode("frames").alias("f"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return frame.select(
        "hadm_id", "all_ids", F.col("f.bin").alias("time_bin"), F.col("f.hour_range").alias("hours"),
        joined("f.specimen_ids").alias("specimen_ids"),
        F.size("f.charttimes_hours").alias("n_times"),
        F.coalesce(F.array_join(F.transform("f.labs_present", lambda x: x["label"]), ","),
                   F.lit("")).alias("labs"))


@query
def video_summary(s, d):
    return ev_summary(s, d)


@query
def run_summary(s, d):
    return meta.run_summary(ev_summary(s, d)).select("metric", "n", six("mean"), six("median"))


@query
def fill_timeline(s, d):
    return meta.fill_timeline(ev_frames(s, d), n_bins=v.EV_BINS)


@query
def frame_fill_dist(s, d):
    return _distribution(meta.frame_fill_distribution(ev_frames(s, d)))


@query
def active_frames(s, d):
    return meta.active_frames(ev_frames(s, d)).select("hadm_id", "time_bin", "n_cells_filled",
                                                      "position")


@query
def completeness_filter(s, d):
    return features.completeness(ev_summary(s, d), at_least=0.022).select(
        "hadm_id", "filled_cells", six("completeness"))


# -- specimens ----------------------------------------------------------------------------


@query
def specimen_cells(s, d):
    return cells.specimen_cells(v.ev_raw(s, d), ev_image_layout(s, d)).select(
        "specimen_id", "row", "col", whole("itemid"),
        F.col("value").cast("double").alias("value"))


@query
def specimen_tensor(s, d):
    events = v.ev_raw(s, d)
    sparse = cells.specimen_cells(events, ev_image_layout(s, d), scaled=True)
    images = tensor.specimen_tensors(sparse, profile.distinct_specimens(events), v.EV_SHAPE)
    return tensor.explode_tensors(images, "specimen_id").select(
        "specimen_id", "position", six("value"))


@query
def grid_reconstruct(s, d):
    layout = ev_image_layout(s, d)
    images = tensor.specimen_tensors(
        cells.specimen_cells(v.ev_raw(s, d), layout), None, v.EV_SHAPE)
    places = grid.positions(layout, v.EV_SHAPE)
    return tensor.labelled_cells(images, "specimen_id", places, v.EV_SHAPE[1]).select(
        "specimen_id", "row", "col", whole("itemid"), "label",
        F.col("value").cast("double").alias("value"))


@query
def numeric_coercion(s, d):
    """Result texts of several forms, made from the event's own numbers."""
    k = v.k_of_props()
    whole_part = F.floor("value").cast("long").cast("string")
    forms = (F.when(k % 6 == 0, F.concat(whole_part, F.lit(".5")))
             .when(k % 6 == 1, F.concat(F.lit("-"), whole_part))
             .when(k % 6 == 2, F.concat(F.lit(">"), whole_part))
             .when(k % 6 == 3, F.concat(whole_part, F.lit("e5")))
             .when(k % 6 == 4, "___").otherwise(whole_part))
    return v.table(s, d, "events").select("event_id", from_number_text(forms).alias("number"))


@query
def refrange_scale(s, d):
    low, high = F.col("ref_range_lower"), F.col("ref_range_upper")
    return v.ev_raw(s, d).select(
        "event_id", six(reference_scaled(F.col("valuenum"), low, high), "scaled"),
        six(reference_scaled(F.col("valuenum"), low, high, clipped=False), "unclipped"),
        six(reference_scaled(F.col("valuenum"), low, high, missing_fill=0.0), "filled"))


@query
def zlog_scale(s, d):
    return v.ev_raw(s, d).select("event_id", six(zlog_scaled(
        F.col("valuenum"), F.col("ref_range_lower"), F.col("ref_range_upper")), "zlog"))


@query
def distinct_specimens(s, d):
    return profile.distinct_specimens(v.ev_raw(s, d))


@query
def rich_specimens(s, d):
    return profile.rich_specimens(v.ev_raw(s, d))


# -- normalisation ------------------------------------------------------------------------


@query
def norm_stats(s, d):
    return ev_stats(s, d, ev_cells(s, d)).select(
        "row", "col", whole("itemid"), "label",
        F.col("log_transform").cast("int").alias("log_transform"), six("mean"), six("std"),
        "count")


@query
def normalized_cells(s, d):
    return cell_columns(ev_normalised(s, d), F.round(F.col("z").cast("double"), 5).alias("z"))


@query
def clip_counters(s, d):
    return normalize.clip_counters(ev_normalised(s, d)).select(
        "n_valid", "n_low", "n_high", "n_unclipped", six("pct_low"), six("pct_high"),
        six("pct_unclipped"))


@query
def extreme_fraction(s, d):
    return normalize.extreme_fraction(ev_normalised(s, d)).select(
        "hadm_id", "n_values", six("pct_extreme"))


@query
def video_value_bounds(s, d):
    sparse = ev_cells(s, d)
    z = normalize.transform(sparse, ev_stats(s, d, sparse))
    return normalize.value_bounds(sparse, z).select(
        "hadm_id", F.round("raw_low", 5).alias("raw_low"), F.round("raw_high", 5)
        .alias("raw_high"), F.round("z_bound", 5).alias("z_bound"))


@query
def robust_scale(s, d):
    return cell_columns(normalize.robust_scaled(ev_cells(s, d)), six("scaled"))


@query
def quantile_scale(s, d):
    return cell_columns(normalize.quantile_scaled(ev_cells(s, d)), six("quantile"))


# -- derived features ---------------------------------------------------------------------


@query
def locf_cells(s, d):
    carried = features.carried_forward(ev_cells(s, d), n_bins=v.EV_BINS)
    return cell_columns(carried, F.col("value").cast("double").alias("value"),
                        F.col("staleness"))


@query
def time_since_last(s, d):
    return cell_columns(features.time_since_last(
        ev_cells(s, d), n_bins=v.EV_BINS, bin_hours=v.EV_BIN_HOURS), F.col("hours_since"))


@query
def sliding_windows(s, d):
    return features.sliding_cells(
        v.ev(s, d), ev_layout(s, d), window_hours=240, stride_hours=120, bin_hours=10).select(
        "hadm_id", "window_start", "time_bin", "row", "col", F.col("value").cast("double").alias("value"))


@query
def subject_split(s, d):
    return features.split_by_subject(v.ev_raw(s, d), seed=None).groupBy("split").agg(
        F.countDistinct("subject_id").alias("n_subjects"), F.count(F.lit(1)).alias("n_events"))


@query
def site_folds(s, d):
    """Leave-one-site-out sizes with the customer's nation as the site."""
    customers = v.table(s, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"))
    stays = v.table(s, d, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    return features.site_folds(stays, "site").select("site", "n_test", "n_train", six("pct_test"))


@query
def shared_concepts(s, d):
    """Units and types of EV mapped to shared concepts, those that LI has as well."""
    mapping = v.voc(s, d).select("itemid", (F.col("itemid") - 1000).cast("long")
                                 .alias("concept_id"), F.lit(0.5).alias("factor"),
                                 F.lit(1.0).alias("shift"))
    local = features.harmonise(v.ev_raw(s, d), mapping)
    both = features.shared_concepts(local, v.li(s, d).select("itemid"))
    return join_by_key(local, both, "itemid", "left_semi").groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n_events"), six(F.max("valuenum"), "value_max"))


# -- distributions ------------------------------------------------------------------------


def _distribution(out: DataFrame) -> DataFrame:
    return out.select("metric", "n", *[
        six(c) for c in ("mean", "p5", "p25", "p50", "p75", "p95", "min", "max")])


@query
def dataset_totals(s, d):
    return profile.dataset_totals(eb_linked(s, d)).select(
        "n_events", "n_admissions", "n_specimens", "hadm_null", "valuenum_null",
        six("hadm_null_pct"), six("valuenum_null_pct"))


@query
def specimen_profile(s, d):
    return profile.specimen_profile(v.ev_raw(s, d))


@query
def admission_profile(s, d):
    return profile.admission_profile(v.ev_raw(s, d)).select(
        "hadm_id", "n_events", "n_labs", "n_specimens", six("hours"))


@query
def sampling_frequency(s, d):
    return profile.sampling_frequency(profile.admission_profile(v.li(s, d))).select(
        "hadm_id", "n_specimens", six("specimens_per_hour"))


@query
def dist_summary_specimen(s, d):
    return _distribution(profile.specimen_distributions(profile.specimen_profile(v.ev_raw(s, d))))


@query
def dist_summary_admission(s, d):
    return _distribution(profile.admission_distributions(profile.admission_profile(v.li(s, d))))


@query
def specimen_gaps(s, d):
    return profile.specimen_gaps(v.ev_raw(s, d))


@query
def histogram_gaps(s, d):
    return profile.histogram(profile.specimen_gaps(v.ev_raw(s, d)), "gap_hours", bins=80,
                             at_most=48.0, density=True).select(
        "bin", six("bin_low"), six("bin_high"), "count", six("density"))


@query
def lab_coverage(s, d):
    covered = profile.lab_coverage(v.li(s, d))
    return profile.with_labels(covered, v.parts(s, d)).select(
        "itemid", "n_events", "n_admissions", "n_specimens", six("admission_pct"), "label",
        "category")


@query
def lab_coverage_subset(s, d):
    covered = profile.lab_coverage(v.ev_raw(s, d), ev_subset(s, d))
    return covered.select(whole("itemid"), "n_events", "n_admissions", "n_specimens",
                          six("admission_pct"))


def _sweep_columns(out: DataFrame) -> DataFrame:
    return out.select("k", "n_units", *[six(c) for c in (
        "mean_labs", "median_labs", "mean_fill", "p5", "p25", "p50", "p75", "p95")])


@query
def grid_sweep_frame(s, d):
    return _sweep_columns(profile.grid_sweep(v.ev_raw(s, d), ev_subset(s, d)))


@query
def grid_sweep_admission(s, d):
    return _sweep_columns(profile.grid_sweep(v.li(s, d), li_subset(s, d), unit="hadm_id"))


@query
def duration_buckets(s, d):
    return profile.duration_buckets(profile.admission_profile(v.li(s, d)))


@query
def feasibility(s, d):
    return profile.feasibility(profile.admission_profile(v.ev_raw(s, d))).select(
        "metric", "at_least", "n_admissions", six("pct"))


@query
def table_profile(s, d):
    out = profile.table_profile(
        eb_linked(s, d), step="lab_with_adm", null_columns=("hadm_id", "specimen_id", "admittime"),
        unique_columns=("subject_id", "hadm_id", "specimen_id"))
    rounded = [six(c) if c.endswith("_pct") else F.col(c) for c in out.columns]
    return out.select(*rounded)


# -- other windows, views and selections --------------------------------------------------


@query
def rich_specimens_stored(s, d):
    """Among specimens with a stored image, here those with an odd id."""
    stored = profile.distinct_specimens(v.ev_raw(s, d)).filter(F.col("specimen_id") % 2 == 1)
    return profile.rich_specimens(v.ev_raw(s, d), having_tensor=stored)


@query
def frame_members(s, d):
    return meta.frame_members(ev_placed(s, d))


@query
def sliding_windows_sparse(s, d):
    """Windows shorter than their stride: events between them fall into none."""
    return features.sliding_cells(
        v.ev(s, d), ev_layout(s, d), window_hours=60, stride_hours=120, bin_hours=10).select(
        "hadm_id", "window_start", "time_bin", "row", "col", F.col("value").cast("double").alias("value"))


@query
def binned_48h(s, d):
    """The alternative schema of 48 hours in bins of two."""
    placed = cells.place_events(v.ev(s, d), ev_layout(s, d), n_bins=24, bin_hours=2)
    return cells.last_cells(placed).select("hadm_id", "time_bin", "row", "col", whole("itemid"),
                                           F.col("value").cast("double").alias("value"))


@query
def binned_mean_wide(s, d):
    """A wide vocabulary with many short stays: mean per bin and type without a grid."""
    inside = v.li(s, d).filter(F.col("hadm_id").isNotNull() & in_bins(v.LI_BINS, v.LI_BIN_HOURS))
    placed = inside.withColumn("time_bin", time_bin(v.LI_BIN_HOURS))
    return cells.mean_cells(placed, keys=("hadm_id", "time_bin", "itemid")).select(
        "hadm_id", "time_bin", whole("itemid"), F.col("value").cast("double").alias("value"))


@query
def binned_other_anchor(s, d):
    """Time zero a day after admission, for the cohort as for the cells."""
    later = v.ev(s, d).withColumn("anchor", F.col("admittime") + F.expr("INTERVAL 1 DAY"))
    chosen = cohort.in_window_ranking(later, window_hours=v.EV_WINDOW_HOURS, anchor="anchor")
    placed = cells.place_events(later, ev_layout(s, d), n_bins=v.EV_BINS,
                                bin_hours=v.EV_BIN_HOURS, cohort=chosen, anchor="anchor")
    return cells.last_cells(placed).select("hadm_id", "time_bin", "row", "col", whole("itemid"),
                                           F.col("value").cast("double").alias("value"))


@query
def norm_train_only(s, d):
    """Channel statistics fitted on three quarters of the stays."""
    train = ev_cohort(s, d).filter(F.col("hadm_id") % 4 != 0)
    fitted = ev_stats(s, d, cohort.keep_cohort(ev_cells(s, d), train))
    return fitted.select("row", "col", whole("itemid"), six("mean"), six("std"), "count")


@query
def specimen_from_text(s, d):
    """Image cells from result texts; every fourth text is no number."""
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(">"), F.col("event_id"))).otherwise(
        F.col("event_id").cast("string"))
    out = cells.specimen_cells(v.ev_raw(s, d).withColumn("value", said), ev_image_layout(s, d),
                               text_column="value")
    return out.select("specimen_id", "row", "col", whole("itemid"),
                      F.col("value").cast("double").alias("value"))


@query
def step_profiles(s, d):
    out = jobs.step_profiles({"lab_parquet": v.ev_raw(s, d), "lab_with_adm": eb_linked(s, d)})
    return out.select("step", "n_rows", *[
        F.coalesce(F.col("nulls")[c], F.lit(-1)).alias(f"{c}_nulls")
        for c in ("hadm_id", "specimen_id", "valuenum", "charttime")])
