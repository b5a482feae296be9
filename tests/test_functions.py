import random

import numpy as np
import pandas as pd
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tessera.functions import counting, quantiles, timing, values
from tessera.functions.lookups import lookup
from tessera.functions.ordered import nearest_known, slice_cuts, sliced


def test_number_text(spark):
    texts = ["12.5", "-3", "1e5", ">10", "1.2.3", "___", "", "-", "7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(values.from_number_text("t")).collect()]
    assert got == [12.5, -3.0, None, None, None, None, None, None, 7.0, None]


@pytest.mark.parametrize("v, lo, hi, want", [
    (5.0, 0.0, 10.0, 0.5), (20.0, 0.0, 10.0, 1.0), (-1.0, 0.0, 10.0, 0.0),
    (0.4, None, None, 0.4), (20.0, None, None, 1.0), (5.0, 10.0, 10.0, 1.0),
    (None, 0.0, 10.0, None), (float("nan"), 0.0, 10.0, None)])
def test_reference_scaled(spark, v, lo, hi, want):
    df = spark.createDataFrame([(v, lo, hi)], "v double, lo double, hi double")
    scaled = values.reference_scaled(F.col("v"), F.col("lo"), F.col("hi"))
    filled = values.reference_scaled(F.col("v"), F.col("lo"), F.col("hi"), missing_fill=-1.0)
    assert df.select(scaled, filled).first() == (want, -1.0 if want is None else want)


def test_zlog_limits_are_two_sided_95_percent(spark):
    df = spark.createDataFrame([(10.0,), (40.0,), (20.0,), (0.0,)], "v double")
    z = values.zlog_scaled(F.col("v"), F.lit(10.0), F.lit(40.0))
    assert [r[0] and round(r[0], 9) for r in df.select(z).collect()] == [-1.96, 1.96, 0.0, None]


def test_log_domain(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (None,)], "v double")
    out = df.select(values.log_where(F.col("v"), F.lit(True)))
    assert [r[0] for r in out.collect()] == [None, None, 0.0, None]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(6.25, 1), (3.125, 2)], "v double, d int")
    assert df.select(values.half_even(F.col("v"), 1)).first()[0] == 6.2
    assert df.filter("d = 2").select(values.half_even(F.col("v"), 2)).first()[0] == 3.12


def test_windows(spark):
    data = [(1, at("01-01 00:00")), (2, at("01-01 23:59")), (3, at("01-02 00:00")),
            (4, at("01-02 12:00")), (5, None)]
    df = (spark.createDataFrame(data, "id int, charttime timestamp_ntz")
          .withColumn("admittime", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))
    assert rows(df.filter(timing.in_window(24)), "id") == [(1,), (2,)]
    assert rows(df.filter(timing.in_first_hours(24)), "id") == [(1,), (2,)]
    # 36 hours hold one whole bin of 24 hours; the cohort window is not cut.
    assert timing.bin_count(36, 24) == 1
    assert rows(df.filter(timing.in_bins(1, 24)), "id") == [(1,), (2,)]
    assert rows(df.filter(timing.in_window(36)), "id") == [(1,), (2,), (3,)]
    assert rows(df, timing.time_bin(12.0)) == [(0,), (1,), (2,), (3,), (None,)]


def test_lookback_is_closed_on_both_ends(spark):
    data = [(1, at("01-01 12:00")), (2, at("01-02 12:00")), (3, at("01-01 11:59")),
            (4, at("01-02 12:01"))]
    df = spark.createDataFrame(data, "id int, charttime timestamp_ntz")
    anchor = F.lit("2020-01-02 12:00:00").cast("timestamp_ntz")
    assert rows(df.filter(timing.in_lookback(24, F.col("charttime"), anchor)), "id") == [(1,), (2,)]


def test_hour_label(spark):
    df = spark.range(3).select(timing.hour_label(F.col("id"), 1.0).alias("l"))
    assert [r[0] for r in df.collect()] == ["0–1h", "1–2h", "2–3h"]


def brute_nearest(frame, forward, include):
    frame = frame.sort_values(["t", "id"], na_position="last")
    out = {}
    for _, group in frame.groupby("p"):
        recs = group.to_dict("records")
        order = recs[::-1] if forward else recs
        known = None
        for r in order:
            has = not pd.isna(r["v"])
            if include and has:
                known = r["v"]
            out[r["id"]] = known
            if not include and has:
                known = r["v"]
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("include", [True, False])
def test_nearest_known_equals_brute_force(spark, forward, include):
    rng = random.Random(7)
    start = pd.Timestamp("2020-01-01")
    # One part holds most rows; times repeat and may be missing.
    data = [(i, 0 if rng.random() < 0.6 else rng.randint(1, 4),
             None if rng.random() < 0.05 else
             (start + pd.Timedelta(hours=rng.randint(0, 400))).to_pydatetime(),
             float(i) if rng.random() < 0.15 else None) for i in range(600)]
    df = spark.createDataFrame(data, "id long, p int, t timestamp_ntz, v double")
    got = nearest_known(df, {"near": "v"}, part="p", time="t", tiebreak=("id",),
                        forward=forward, include_current=include)
    want = brute_nearest(pd.DataFrame(data, columns=["id", "p", "t", "v"]), forward, include)
    assert {r["id"]: r["near"] for r in got.collect()} == want


@pytest.mark.parametrize("times", ["one_day", "one_moment", "none"])
@pytest.mark.parametrize("forward", [True, False])
def test_slices_of_a_long_history_are_even_whatever_its_times(spark, times, forward):
    rng = random.Random(5)
    start = pd.Timestamp("2020-01-01")

    def when():
        spread = {"one_day": rng.randint(0, 80_000), "one_moment": 7, "none": None}[times]
        return None if spread is None else (start + pd.Timedelta(seconds=spread)).to_pydatetime()

    # Two thirds of all rows are one subject's.
    data = [(i, 0 if i % 3 else i, when(), float(i) if rng.random() < 0.01 else None) for i in range(9_000)]
    df = spark.createDataFrame(data, "id long, p long, t timestamp_ntz, v double")
    order_of = {"part": "p", "time": "t", "tiebreak": ("id",)}
    sizes = [r["count"] for r in sliced(df, slice_cuts(df, **order_of, slice_rows=400), **order_of)
             .filter("p = 0").groupBy("_slice").count().collect()]
    assert sum(sizes) == 6_001 and 10 <= len(sizes) <= 24 and max(sizes) < 1_000
    got = nearest_known(df, {"near": "v"}, **order_of, forward=forward, include_current=True, slice_rows=400)
    want = brute_nearest(pd.DataFrame(data, columns=["id", "p", "t", "v"]), forward, True)
    assert {r["id"]: r["near"] for r in got.collect()} == want


def test_slices_by_several_tie_breaks(spark):
    data = [(i % 50, i, 0, None if i % 9 else float(i)) for i in range(3_000)]
    df = spark.createDataFrame(data, "a int, b int, p int, v double").withColumn("t", F.lit(None).cast("timestamp_ntz"))
    order_of = {"part": "p", "time": "t", "tiebreak": ("a", "b")}
    assert sliced(df, slice_cuts(df, **order_of, slice_rows=200), **order_of).select("_slice").distinct().count() > 8
    got = nearest_known(df, {"near": "v"}, **order_of, forward=False, include_current=True, slice_rows=200)
    last, want = None, {}
    for a, b, _, v in sorted(data):
        last = v if v is not None else last
        want[a, b] = last
    assert {(r["a"], r["b"]): r["near"] for r in got.collect()} == want


def test_distinct_values_copy_no_rows(spark):
    df = spark.range(5_000).selectExpr("id % 7 AS a", "if(id % 5 = 0, null, id % 900) AS b")
    got = df.agg(F.count(F.lit(1)).alias("n")).select("n", *[counting.distinct_values(df, c).alias(c) for c in "ab"])
    assert got.first() == (5_000, 7, 720)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_lookup_spreads_null_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = spark.range(4000).select(
            F.col("id").alias("event_id"),
            F.when(F.col("id") % 5 < 2, None).otherwise(F.col("id") % 50).alias("hadm_id"))
        table = spark.range(50).select(F.col("id").alias("hadm_id"), (F.col("id") * 2).alias("x"))
        joined = lookup(events, table, "hadm_id", spread_by=("event_id",))
        per_task = (joined.filter("hadm_id is null").groupBy(F.spark_partition_id()).count()
                    .agg(F.max("count"), F.sum("count")).first())
        assert per_task[1] == 1600 and per_task[0] < 800
        assert joined.count() == 4000
        assert joined.filter("hadm_id is not null and x != hadm_id * 2").count() == 0
        assert joined.filter("hadm_id is null and x is not null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("kind", ["normal", "constant", "few", "heavy_tail", "one", "two"])
def test_percentiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(size=5000), "constant": np.full(100, 2.5),
            "few": rng.integers(0, 4, 3000).astype(float), "heavy_tail": rng.pareto(1, 4000),
            "one": np.array([4.0]), "two": np.array([1.0, 2.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"metric": kind, "value": data}))
    got = quantiles.percentiles(df, ["metric"], percents=(1, 5, 25, 50, 75, 95, 99)).first()
    for q in (1, 5, 25, 50, 75, 95, 99):
        assert got[f"p{q}"] == pytest.approx(np.percentile(data, q), abs=1e-12)
    assert (got["n"], got["min"], got["max"]) == (len(data), data.min(), data.max())
    assert got["mean"] == pytest.approx(data.mean())


def test_percentiles_of_all_signs_and_sizes(spark):
    rng = np.random.default_rng(8)
    data = np.concatenate((rng.normal(size=300) * 10.0 ** rng.integers(-12, 300, 300), [0.0, -0.0, 1e-300, -1e-300, np.inf, -np.inf] * 3))
    # One value is most of a group.
    data = np.concatenate((data, np.full(2_000, 0.5)))
    df = spark.createDataFrame(pd.DataFrame({"metric": "m", "value": data}))
    got = quantiles.percentiles(df, ["metric"], percents=(2, 10, 50, 95)).first()
    ordered = np.sort(data)
    for q in (2, 10, 50, 95):
        low, high = (ordered[int(f(q / 100 * (len(data) - 1)))] for f in (np.floor, np.ceil))
        assert got[f"p{q}"] == low if low == high else low <= got[f"p{q}"] <= high
    assert (got["n"], got["min"], got["max"]) == (len(data), -np.inf, np.inf)
    assert quantiles.percentiles(df.limit(0), ["metric"]).count() == 0


def test_value_ranks_equal_pandas(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 2000), "value": rng.integers(0, 90, 2000) / 10})
    got = quantiles.value_ranks(spark.createDataFrame(frame), ["g"]).toPandas()
    assert got["copies"].sum() == 2000
    for _, r in got.iterrows():
        group = frame[frame.g == r.g].value
        assert r.below == (group < r.value).sum() and r.n == len(group)


def test_stack_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    out = quantiles.stack(df, {"a": F.col("a"), "b": F.col("b")})
    assert rows(out) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]


def test_distinct_counts_equal_pandas(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], 800), "a": rng.integers(0, 40, 800),
                          "b": rng.integers(0, 7, 800).astype(float)})
    frame.loc[::5, "b"] = np.nan
    frame["t"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, 800), "m")
    df = spark.createDataFrame(frame).select(
        "k", "a", F.when(~F.isnan("b"), F.col("b").cast("int")).alias("b"),
        F.col("t").cast("timestamp_ntz").alias("t"))
    got = counting.count_with_distincts(df, "k", {"n_a": "a", "n_b": "b"}, time="t").toPandas()
    for _, r in got.iterrows():
        g = frame[frame.k == r.k]
        assert (r.n_events, r.n_a, r.n_b) == (len(g), g.a.nunique(), g.b.nunique())
        assert (r.first_at, r.last_at) == (g.t.min(), g.t.max())
