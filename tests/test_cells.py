import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tessera.operators import cells, features, grid, meta, tensor

EVENTS = ("event_id long, hadm_id long, specimen_id long, itemid int, charttime timestamp_ntz, "
          "admittime timestamp_ntz, valuenum double, ref_range_lower double, "
          "ref_range_upper double")
ADMIT = at("01-01 00:00")
SHAPE = (2, 2)


def event(i, time, value, *, hadm=1, specimen=10, item=1, low=None, high=None):
    return (i, hadm, specimen, item, at(time), ADMIT, value, low, high)


@pytest.fixture(scope="module")
def layout(spark):
    vocabulary = spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "x"), (3, "c", None)], "itemid int, label string, category string")
    return grid.layout_of_vocabulary(vocabulary, SHAPE)


@pytest.fixture(scope="module")
def placed(spark, layout):
    data = [
        event(1, "01-01 00:10", 5.0), event(2, "01-01 00:20", None),       # null does not overwrite
        event(3, "01-01 01:10", 1.0), event(4, "01-01 01:10", 2.0),        # tie: later id wins
        event(5, "01-01 02:00", float("nan"), specimen=11),                # NaN is missing
        event(6, "01-01 02:30", None, hadm=2, specimen=20),                # only a null value
        event(7, "01-01 03:00", 9.0),                                      # end of the window
        event(8, "01-01 00:30", 4.0, item=99),                             # not on the grid
        event(9, "01-01 00:40", 7.0, item=3, specimen=12),
    ]
    events = spark.createDataFrame(data, EVENTS)
    return cells.place_events(events, layout, n_bins=3, bin_hours=1)


def test_last_present_value_wins(placed):
    assert rows(cells.last_cells(placed), "hadm_id", "time_bin", "row", "col", "value") == [
        (1, 0, 0, 0, 5.0), (1, 0, 1, 0, 7.0), (1, 1, 0, 0, 2.0)]


def test_mean_and_count(placed):
    assert rows(cells.mean_cells(placed), "time_bin", "row", "value") == [
        (0, 0, 5.0), (0, 1, 7.0), (1, 0, 1.5)]
    assert rows(cells.count_cells(placed), "time_bin", "row", "n_values") == [
        (0, 0, 1), (0, 1, 1), (1, 0, 2)]


def test_frames_count_events_without_value(spark, placed):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "hadm_id long")
    frames = meta.frame_metadata(placed, cohort, n_bins=3, n_cells=4)
    assert rows(frames, "hadm_id", "time_bin", "n_cells_filled", "fill_pct",
                "n_specimens_merged", "time_span_minutes", "value_min", "value_max") == [
        (1, 0, 2, 50.0, 2, 30.0, 5.0, 7.0), (1, 1, 1, 25.0, 1, 0.0, 2.0, 2.0),
        (1, 2, 0, 0.0, 1, 0.0, None, None), (2, 0, 0, 0.0, 0, 0.0, None, None),
        (2, 1, 0, 0.0, 0, 0.0, None, None), (2, 2, 0, 0.0, 1, 0.0, None, None),
        (3, 0, 0, 0.0, 0, 0.0, None, None), (3, 1, 0, 0.0, 0, 0.0, None, None),
        (3, 2, 0, 0.0, 0, 0.0, None, None)]


def test_summary_and_its_invariants(spark, placed):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "hadm_id long")
    out = meta.video_summary(placed, cohort, n_bins=3, n_cells=4)
    assert rows(out, "hadm_id", "filled_cells", "fill_pct", "frames_with_data", "frames_empty",
                "temporal_density_pct", "total_specimens_merged") == [
        (1, 3, 25.0, 2, 1, 66.7, 3), (2, 0, 0.0, 0, 3, 0.0, 1), (3, 0, 0.0, 0, 3, 0.0, 0)]
    assert out.filter("filled_cells > total_cells or frames_with_data + frames_empty != 3"
                      ).count() == 0


def test_documents(spark, placed, layout):
    cohort = spark.createDataFrame([(1,), (3,)], "hadm_id long")
    docs = meta.video_documents(placed, layout, cohort, n_bins=3,
                                bin_hours=1, shape=SHAPE)
    doc = docs.filter("hadm_id = 1").first()
    assert doc["video_shape"] == [3, 2, 2] and doc["window_hours"] == 3.0
    assert doc["video_summary"]["specimen_ids"] == [10, 11, 12]
    first, _, last = doc["frames"]
    assert first["hour_range"] == "0–1h" and first["charttimes_hours"] == [0.17, 0.33, 0.67]
    assert [x["label"] for x in first["labs_present"]] == ["a", "c"]
    assert last["labs_present"] is None and last["specimen_ids"] == [11]
    empty = docs.filter("hadm_id = 3").first()
    assert len(empty["frames"]) == 3 and empty["video_summary"]["specimen_ids"] == []
    tensors = tensor.video_tensors(cells.last_cells(placed), cohort, (3, 2, 2))
    assert meta.with_documents(tensors, docs).filter("video_shape is null").count() == 0


def test_dense_video_and_back(spark, placed):
    cohort = spark.createDataFrame([(1,), (3,)], "hadm_id long")
    last = cells.last_cells(placed)
    got = {r["hadm_id"]: (r["shape"], np.array(r["values"]).reshape(r["shape"]))
           for r in tensor.video_tensors(last, cohort, (3, 2, 2)).collect()}
    want = np.full((3, 2, 2), np.nan)
    want[0, 0, 0], want[0, 1, 0], want[1, 0, 0] = 5, 7, 2
    assert np.array_equal(got[1][1], want, equal_nan=True)
    assert np.isnan(got[3][1]).all() and got[3][0] == [3, 2, 2]
    dense = tensor.video_tensors(last, cohort, (3, 2, 2))
    back = tensor.explode_tensors(dense, "hadm_id").filter("value is not null")
    assert rows(back) == [(1, 0, 5.0), (1, 2, 7.0), (1, 4, 2.0)]
    mask = tensor.observation_mask(dense).filter("hadm_id = 1").first()["mask"]
    assert mask == [True, False, True, False, True] + [False] * 7


@pytest.mark.parametrize("filled", [[], [0], [11], [0, 11], [3, 4, 7], list(range(12))])
def test_densify_places(spark, filled):
    sparse = spark.createDataFrame([(1, 0, p // 4, p % 4, float(p)) for p in filled],
                                   "hadm_id long, time_bin int, row int, col int, value float")
    ids = spark.createDataFrame([(1,)], "hadm_id long")
    out = tensor.video_tensors(sparse, ids, (1, 3, 4), missing=None).first()["values"]
    assert out == [float(p) if p in filled else None for p in range(12)]


def test_tensor_profiles(spark):
    df = spark.createDataFrame(
        [(1, [2, 2], [1.0, float("nan"), -3.0, None]), (2, [2, 2], [float("nan")] * 4)],
        "specimen_id long, shape array<int>, values array<float>")
    assert rows(tensor.tensor_profile(df, "specimen_id")) == [
        (1, 4, 2, -3.0, 1.0), (2, 4, 0, None, None)]
    assert tuple(tensor.tensor_overview(df).first()) == (2, 1, [2, 2], True)
    empty = tensor.tensor_overview(df.filter("specimen_id > 5")).first()
    assert (empty["n_tensors"], empty["all_same_shape"]) == (0, False)


def test_specimen_null_clears_an_earlier_value(spark, layout):
    data = [event(1, "01-01 00:10", 5.0), event(2, "01-01 00:20", None),
            event(3, "01-01 00:10", 6.0, item=2, low=4.0, high=8.0),
            event(4, "01-01 00:10", 30.0, item=3, specimen=11)]
    events = spark.createDataFrame(data, EVENTS)
    raw = cells.specimen_cells(events, layout)
    assert rows(raw, "specimen_id", "row", "col", "value") == [
        (10, 0, 1, 6.0), (11, 1, 0, 30.0)]
    scaled = cells.specimen_cells(events, layout, scaled=True)
    assert rows(scaled, "specimen_id", "value") == [(10, 0.5), (11, 1.0)]
    one = spark.createDataFrame([(11,)], "specimen_id long")
    assert rows(cells.specimen_cells(events, layout, specimens=one), "specimen_id") == [(11,)]
    images = tensor.specimen_tensors(raw, None, SHAPE)
    places = grid.positions(layout, SHAPE)
    shown = tensor.labelled_cells(images, "specimen_id", places, 2, all_cells=True)
    assert rows(shown.filter("specimen_id = 10"), "row", "col", "itemid", "label", "value") == [
        (0, 0, 1, "a", None), (0, 1, 2, "b", 6.0), (1, 0, 3, "c", None), (1, 1, 0, "(empty)", None)]
    assert tensor.labelled_cells(images, "specimen_id", places, 2).count() == 2


def test_carried_and_time_since(spark):
    sparse = spark.createDataFrame([(1, 1, 0, 0, 5.0), (1, 3, 0, 0, 6.0)],
                                   "hadm_id long, time_bin int, row int, col int, value float")
    carried = features.carried_forward(sparse, n_bins=5)
    assert rows(carried, "time_bin", "value", "staleness") == [
        (1, 5.0, 0), (2, 5.0, 1), (3, 6.0, 0), (4, 6.0, 1)]
    since = features.time_since_last(sparse, n_bins=5, bin_hours=2)
    assert rows(since, "time_bin", "hours_since") == [(1, 0.0), (2, 2.0), (3, 0.0), (4, 2.0)]


def test_sliding_windows_repeat_events(spark, layout):
    events = spark.createDataFrame([event(1, "01-01 06:00", 1.0), event(2, "01-02 00:00", 2.0)],
                                   EVENTS)
    out = features.sliding_windows(events, layout, window_hours=24, stride_hours=12, bin_hours=1)
    assert rows(out, "event_id", "window_start", "time_bin") == [
        (1, 0, 6), (2, 12, 12), (2, 24, 0)]


def test_other_anchor(spark, layout):
    events = spark.createDataFrame([event(1, "01-01 06:00", 1.0)], EVENTS).withColumn(
        "edregtime", F.lit("2020-01-01 05:00:00").cast("timestamp_ntz"))
    out = cells.place_events(events, layout, n_bins=3, bin_hours=1, anchor="edregtime")
    assert rows(out, "time_bin") == [(1,)]


@pytest.mark.parametrize("n_bins", [3, 62, 63, 130])
def test_members_give_what_separate_aggregates_give(spark, n_bins):
    rng = random.Random(n_bins)
    data = [(i, 7 if i % 3 else i % 5, rng.choice([None, *range(20)]), rng.choice([1, 2, 3, 9]),
             at("01-01 00:00") + timedelta(minutes=rng.randint(-60, 60 * n_bins + 90)), rng.choice([None, 1.0, 2.5, float(i)]),
             at("01-01 00:00")) for i in range(900)]
    events = spark.createDataFrame(data, "event_id long, hadm_id long, specimen_id long, itemid long, "
                                         "charttime timestamp_ntz, valuenum double, admittime timestamp_ntz")
    layout = spark.createDataFrame([(0, 0, 0, 1, "a"), (1, 0, 1, 2, "b"), (2, 1, 0, 3, "c")],
                                   "index int, row int, col int, itemid long, label string")
    placed = cells.place_events(events, layout, n_bins=n_bins, bin_hours=1)
    chosen = spark.createDataFrame([(7,), (1,), (99,)], "hadm_id long")
    folded = meta.members(placed, chosen, n_bins=n_bins, times=True)
    assert rows(meta.cells_of(folded)) == rows(cells.last_cells(placed), "hadm_id", "time_bin", "row", "col", "itemid", "value")
    frames = {(r.hadm_id, r.time_bin): r for r in meta.frames_of(folded, n_bins=n_bins, n_cells=4).collect()}
    assert set(frames) == {(h, b) for h in (1, 7, 99) for b in range(n_bins)}
    stays = {r.hadm_id: r for r in meta.summary_of(folded, n_bins=n_bins, n_cells=4).collect()}
    records = {r.hadm_id: r for r in meta.documents_of(folded, layout, n_bins=n_bins, bin_hours=1, shape=(2, 2)).collect()}
    held = {}
    for r in placed.collect():
        held.setdefault(r.hadm_id, {}).setdefault(r.time_bin, []).append(r)
    for h in (1, 7, 99):
        ids = {r.specimen_id for rs in held.get(h, {}).values() for r in rs} - {None}
        assert stays[h].total_specimens_merged == records[h].video_summary.total_specimens_merged == len(ids)
        assert records[h].video_summary.specimen_ids == sorted(ids)
        for b in range(n_bins):
            rs = held.get(h, {}).get(b, [])
            f, d = frames[h, b], records[h].frames[b]
            assert f.n_specimens_merged == len({r.specimen_id for r in rs} - {None}) == len(d.specimen_ids)
            assert f.n_cells_filled == len({r.itemid for r in rs if r.valuenum is not None}) == len(d.labs_present or [])
            assert len(d.charttimes_hours) == len({r.elapsed for r in rs})
            assert stays[h].filled_cells == sum(frames[h, k].n_cells_filled for k in range(n_bins))
    assert stays[7].frames_with_data == sum(frames[7, k].n_cells_filled > 0 for k in range(n_bins))


def test_stays_of_the_window_count_without_a_cohort(spark):
    data = [(1, 1, 5, 1, at("01-01 01:00"), 1.0), (2, 2, 6, 9, at("01-01 01:00"), 1.0), (3, 3, None, 1, at("01-01 01:00"), 1.0),
            (4, 4, 7, 1, at("01-01 02:10"), 1.0), (5, 5, 8, 1, at("01-01 02:40"), 1.0)]
    events = spark.createDataFrame([(*d, at("01-01 00:00")) for d in data],
                                   "event_id long, hadm_id long, specimen_id long, itemid long, charttime timestamp_ntz, "
                                   "valuenum double, admittime timestamp_ntz")
    layout = spark.createDataFrame([(1, 0, 0)], "itemid long, row int, col int")
    # Two whole bins in a window of two and a half hours.
    seen = cells.window_events(events, layout, n_bins=2, bin_hours=1, window_hours=2.5)
    out = meta.summary_of(meta.members(seen, n_bins=2), n_bins=2, n_cells=1)
    assert rows(out, "hadm_id", "filled_cells", "total_specimens_merged") == [(1, 1, 1), (2, 0, 0), (4, 0, 0)]
