import numpy as np
import pandas as pd
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tessera.operators import grid, normalize, profile

CELLS = "hadm_id long, time_bin int, row int, col int, itemid int, value float"


def places(spark, shape=(2, 2)):
    layout = grid.layout_of_vocabulary(spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "x"), (3, "c", "x")],
        "itemid int, label string, category string"), shape)
    return grid.positions(layout, shape)


def test_fit_edge_cases(spark):
    # Place 0: three equal values; 1: one value; 2: log channel out of domain; 3: no type.
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, 1, 7.0), (1, 1, 0, 0, 1, 7.0), (1, 2, 0, 0, 1, 7.0), (1, 0, 0, 1, 2, 4.0),
         (1, 0, 1, 0, 3, -1.0), (1, 1, 1, 0, 3, -2.0)], CELLS)
    stats = normalize.fit(cells, places(spark), log_itemids=(3,))
    assert rows(stats, "row", "col", "log_transform", "mean", "std", "count") == [
        (0, 0, False, 7.0, 1.0, 3), (0, 1, False, 4.0, 1.0, 1), (1, 0, True, 0.0, 1.0, 0),
        (1, 1, False, 0.0, 1.0, 0)]
    assert normalize.transform(cells, stats).filter("row = 1").count() == 0


def test_fit_and_transform_equal_numpy(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({
        "hadm_id": rng.integers(0, 20, 3000), "time_bin": 0, "row": 0,
        "col": rng.integers(0, 2, 3000), "value": rng.lognormal(2, 1, 3000).astype("float32")})
    frame["itemid"] = frame.col + 1
    cells = spark.createDataFrame(frame).select(
        "hadm_id", "time_bin", *[F.col(c).cast("int") for c in ("row", "col", "itemid")], "value")
    stats = normalize.fit(cells, places(spark), log_itemids=(1,))
    z = normalize.transform(cells, stats).toPandas()
    for col in (0, 1):
        x = frame[frame.col == col].value.to_numpy().astype("float64")
        x = np.log1p(x) if col == 0 else x
        want = np.clip((x - x.mean()) / x.std(ddof=1), -10, 10)
        got = z[z.col == col].z.to_numpy()
        assert np.allclose(np.sort(got), np.sort(want), atol=1e-5)
        # Before clipping a fitted channel has mean 0 and deviation 1.
        assert abs(want.mean()) < 0.05
    assert z.z.between(-10, 10).all() and len(z) == 3000


def test_report_and_counters(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1.0), (1, 1, 0, 0, 1, 2.0)], CELLS)
    stats = normalize.fit(cells, places(spark), log_itemids=(2, 3))
    out = normalize.report(stats).first()
    assert (out["clip_range"], out["n_labs"], out["n_log_transformed"]) == ([-10.0, 10.0], 4, 2)
    assert out["labs"][0]["std"] == 0.707107 and out["labs"][3]["label"] == "?"
    z = spark.createDataFrame([(1, -10.0), (1, 10.0), (1, 10.0), (1, 3.5), (2, 0.0)],
                              "hadm_id long, z float")
    assert tuple(normalize.clip_counters(z).first()) == (5, 1, 2, 2, 20.0, 40.0, 40.0)
    assert normalize.clip_counters(z.limit(0)).first()["n_valid"] == 0
    assert rows(normalize.extreme_fraction(z)) == [(1, 4, 100.0), (2, 1, 0.0)]


def test_value_bounds_are_kept_between_1_and_5(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 3.0), (2, 0, 0, 0, 1, 4.0)], CELLS)
    z = spark.createDataFrame([(1, 9.0), (2, 0.1)], "hadm_id long, z float")
    assert rows(normalize.value_bounds(cells, z), "hadm_id", "raw_low", "z_bound") == [
        (1, 3.0, 5.0), (2, 4.0, 1.0)]


def test_robust_and_quantile_scaling(spark):
    cells = spark.createDataFrame([(1, b, 0, 0, 1, float(x)) for b, x in enumerate([1, 2, 3, 4, 90])]
                                  + [(1, 0, 0, 1, 2, 7.0)], CELLS)
    assert rows(normalize.robust_scaled(cells), "row", "col", "scaled") == [
        (0, 0, -1.0), (0, 0, -0.5), (0, 0, 0.0), (0, 0, 0.5), (0, 0, 43.5), (0, 1, 0.0)]
    assert rows(normalize.quantile_scaled(cells), "col", "quantile") == [
        (0, 0.0), (0, 0.25), (0, 0.5), (0, 0.75), (0, 1.0), (1, 0.0)]


def test_gaps_follow_first_specimen_times(spark):
    data = [(1, 10, at("01-01 00:00")), (1, 10, at("01-09 00:00")), (1, 11, at("01-01 06:00")),
            (1, 12, at("03-01 06:00")), (2, 20, at("01-01 00:00")), (1, None, at("01-01 01:00"))]
    events = spark.createDataFrame(data, "hadm_id long, specimen_id long, charttime timestamp_ntz")
    assert rows(profile.specimen_gaps(events)) == [(1, 11, 6.0), (1, 12, 1440.0)]


def test_frequency_is_zero_without_duration(spark):
    df = spark.createDataFrame([(1, 4, 2.0), (2, 3, 0.0), (3, 3, None)],
                               "hadm_id long, n_specimens long, hours double")
    assert rows(profile.sampling_frequency(df), "hadm_id", "specimens_per_hour") == [
        (1, 2.0), (2, 0.0), (3, 0.0)]


def test_duration_buckets(spark):
    data = [(0.0, 1, 5), (23.9, 3, 7), (24.0, 9, 9), (100.0, 2, 2), (300.0, 4, 4), (336.0, 6, 6)]
    df = spark.createDataFrame(data, "hours double, n_specimens long, n_labs long")
    assert rows(profile.duration_buckets(df)) == [
        ("24h–72h", 1, 9.0, 9.0), ("72h–7d", 1, 2.0, 2.0), ("7d–14d", 1, 4.0, 4.0),
        ("<24h", 2, 2.0, 6.0), (">14d", 1, 6.0, 6.0)]


def test_feasibility(spark):
    df = spark.createDataFrame([(4, 20), (3, 100)], "n_specimens long, n_labs long")
    got = {(r["metric"], r["at_least"]): (r["n_admissions"], r["pct"])
           for r in profile.feasibility(df).collect()}
    assert got[("n_specimens", 4)] == (1, 50.0) and got[("n_labs", 20)] == (2, 100.0)
    assert len(got) == 12


@pytest.mark.parametrize("data, bins, top", [
    (list(range(11)), 5, None), ([0.0, 0.1, 0.2, 9.0, 60.0], 4, 48.0), ([3.0, 3.0], 4, None)])
def test_histogram_equals_numpy(spark, data, bins, top):
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    kept = [x for x in data if top is None or x <= top]
    count, edges = np.histogram(kept, bins=bins)
    density, _ = np.histogram(kept, bins=bins, density=True)
    out = profile.histogram(df, "v", bins=bins, at_most=top, density=True)
    got = {r["bin"]: r for r in out.collect()}
    assert {b: r["count"] for b, r in got.items()} == {
        i: int(n) for i, n in enumerate(count)}
    for b, r in got.items():
        assert r["bin_low"] == pytest.approx(edges[b])
        assert r["density"] == pytest.approx(density[b])


def test_null_is_one_distinct_value_in_the_table_profile(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, None)], "subject_id long, hadm_id long")
    out = profile.table_profile(df, null_columns=("hadm_id", "absent"),
                                unique_columns=("subject_id", "hadm_id"))
    got = out.first().asDict()
    assert got == {"step": "table", "n_rows": 3, "n_columns": 2, "hadm_id_nulls": 2,
                   "hadm_id_null_pct": pytest.approx(200 / 3), "subject_id_unique": 2,
                   "hadm_id_unique": 2}
    assert profile.table_profile(df.limit(0), null_columns=("hadm_id",)).first()[
        "hadm_id_null_pct"] == 0.0


def test_sweep_counts_units_with_a_lab_in_the_grid_only(spark):
    data = [(1, 10, i) for i in range(1, 5)] + [(1, 11, 1), (2, 20, 1), (2, 20, 9), (2, 21, 9)]
    events = spark.createDataFrame(data, "hadm_id long, specimen_id long, itemid int")
    subset = events.select("hadm_id").distinct()
    out = profile.grid_sweep(events, subset, sizes=(1, 3))
    # Ranking: 1 (three events), 9 (two), then 2, 3, 4.
    assert rows(out, "k", "n_units", "mean_labs", "mean_fill") == [
        (1, 3, 1.0, 100.0), (3, 4, 1.5, 50.0)]
    stays = profile.grid_sweep(events, subset, unit="hadm_id", sizes=(3,))
    assert rows(stays, "n_units", "mean_labs") == [(2, 2.0)]


def test_rich_specimens_with_stored_tensor(spark):
    data = [(10, 1)] * 5 + [(11, 1)] * 4 + [(12, 2)] * 3 + [(13, 1)] * 2
    events = spark.createDataFrame(data, "specimen_id long, itemid int")
    stored = spark.createDataFrame([(11,), (13,)], "specimen_id long")
    assert rows(profile.rich_specimens(events, top=2)) == [(10, 5, 1), (11, 4, 1)]
    # Twice the wanted number is looked at, so a top of 1 sees specimens 10 and 11.
    assert rows(profile.rich_specimens(events, top=1, having_tensor=stored)) == [(11, 4, 1)]
