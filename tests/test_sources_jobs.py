import json

import numpy as np
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tessera.operators import grid, normalize, tensor
from tessera.plans import jobs
from tessera.session import cut_lineage
from tessera.sources import reports, schemas, tables, text

EVENTS_CSV = """labevent_id,subject_id,hadm_id,specimen_id,itemid,charttime,value,valuenum,ref_range_lower,ref_range_upper,flag
1,7,100,10,1,2020-01-01 01:00:00,5,5.0,0,10,
2,7,,10,2,2019-12-31 20:00:00,___,NA,N/A,NULL,abnormal
3,7,100,11,1,2020-01-01 02:30:00,"7,5",7.5,0,10,___
4,8,101,20,1,2020-01-05 00:30:00,3,3.0,0,10,
5,8,101,20,3,2020-01-05 00:45:00,1,1.0,,,
"""
ADMISSIONS_CSV = """subject_id,hadm_id,admittime,dischtime,edregtime,race
7,100,2020-01-01 00:00:00,2020-01-03 00:00:00,,___
8,101,2020-01-05 00:00:00,2020-01-06 00:00:00,2020-01-04 23:00:00,OTHER
"""
VOCABULARY_CSV = """itemid,label,fluid,category
1,Sodium,Blood,Chemistry
2,pH,Blood,Blood Gas
3,"Rare, one",Blood,
"""


@pytest.fixture()
def files(tmp_path):
    paths = {}
    for name, body in (("events", EVENTS_CSV), ("admissions", ADMISSIONS_CSV),
                       ("vocabulary", VOCABULARY_CSV)):
        (tmp_path / f"{name}.csv").write_text(body)
        paths[name] = str(tmp_path / f"{name}.csv")
    return tmp_path, paths


def test_events_csv(spark, files):
    df = text.read_events_csv(spark, files[1]["events"])
    assert df.columns[-1] == "flag" and df.schema["charttime"].dataType.typeName() == "timestamp_ntz"
    row = df.filter("labevent_id = 2").first()
    assert [row[c] for c in ("hadm_id", "value", "valuenum", "ref_range_lower",
                             "ref_range_upper")] == [None] * 5
    assert df.filter("labevent_id = 3").first()["value"] == "7,5"
    assert rows(df, "labevent_id", "flag") == [
        (1, None), (2, "abnormal"), (3, None), (4, None), (5, None)]


def test_admissions_csv_reads_five_columns_only(spark, files):
    df = text.read_admissions_csv(spark, files[1]["admissions"])
    assert df.columns == schemas.ADMISSIONS.fieldNames()
    assert rows(df, "hadm_id", "race") == [(100, None), (101, "OTHER")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dischtime" not in plan.split("ReadSchema")[-1]


def test_bad_value_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(EVENTS_CSV + "x,7,100,10,1,2020-01-01 01:00:00,5,5,0,1,\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_events_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_malformed_row_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(EVENTS_CSV + "9,7\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        text.read_events_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_parquet_round_trip_fallback_and_size(spark, tmp_path):
    raw, linked = str(tmp_path / "raw"), str(tmp_path / "linked")
    df = spark.range(50).withColumn("specimen_id", F.col("id") % 5)
    tables.write(df, raw)
    assert any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "raw").iterdir())
    assert tables.read_events(spark, linked=linked, raw=raw).count() == 50
    tables.write(df.limit(3), linked)
    assert tables.read_events(spark, linked=linked, raw=raw).count() == 3
    assert tables.read(spark, raw, linked).count() == 53
    size = tables.dataset_size(tables.read(spark, raw)).first()
    on_disk = [p.stat().st_size for p in (tmp_path / "raw").glob("*.parquet")]
    assert size["n_files"] == len(on_disk)
    assert size["size_mb"] == pytest.approx(sum(on_disk) / 2**20)
    point = tables.specimen_events(tables.read(spark, raw), 2)
    assert "EqualTo(specimen_id,2)" in point._jdf.queryExecution().executedPlan().toString()
    assert point.count() == 10


def test_layout_and_stats_json(spark, tmp_path):
    vocabulary = spark.createDataFrame([(1, "a", "x"), (2, "b", None)],
                                       "itemid int, label string, category string")
    layout = grid.layout_of_vocabulary(vocabulary, (2, 2))
    reports.write_layout(layout, str(tmp_path / "layout"))
    assert rows(reports.read_layout(spark, str(tmp_path / "layout"))) == rows(layout)
    (tmp_path / "array.json").write_text(json.dumps(
        [r.asDict() for r in layout.collect()], indent=2))
    assert rows(reports.read_layout(spark, str(tmp_path / "array.json"))) == rows(layout)
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1.0), (1, 1, 0, 0, 1, 2.0)],
                                  "hadm_id long, time_bin int, row int, col int, itemid int, "
                                  "value float")
    stats = normalize.fit(cells, grid.positions(layout, (2, 2)), log_itemids=())
    reports.write_json(normalize.report(stats), str(tmp_path / "stats"), one_file=True)
    back = reports.read_stats_report(spark, str(tmp_path / "stats"))
    assert rows(back, "row", "col", "mean", "std", "count") == [
        (0, 0, 1.5, 0.707107, 2), (0, 1, 0.0, 1.0, 0), (1, 0, 0.0, 1.0, 0), (1, 1, 0.0, 1.0, 0)]


def test_files_to_images(spark, files):
    folder, paths = files
    out, events, linked = (str(folder / n) for n in ("images", "events", "linked"))
    jobs.ingest(spark, paths["admissions"], str(folder / "admissions"), mode="admissions")
    jobs.image_files(spark, out=out, vocabulary_csv=paths["vocabulary"], events=events,
                     events_csv=paths["events"], admissions=str(folder / "admissions"),
                     linked=linked, shape=(2, 2))
    linked_events = tables.read(spark, linked)
    # Event 2 was four hours before admission 100.
    assert rows(linked_events, "labevent_id", "hadm_id") == [
        (1, 100), (2, 100), (3, 100), (4, 101), (5, 101)]
    images = tables.read(spark, out)
    assert rows(tables.tensor_ids(images, "specimen_id")) == [(10,), (11,), (20,)]
    got = {r["specimen_id"]: np.array(r["values"]) for r in images.collect()}
    # Places: pH, sodium, the type without category, one free place.
    assert np.array_equal(got[20], [np.nan, 3.0, 1.0, np.nan], equal_nan=True)
    assert np.array_equal(got[10], [np.nan, 5.0, np.nan, np.nan], equal_nan=True)


def test_videos_normalised_from_stored_tensors(spark, files):
    folder, paths = files
    vocabulary = text.read_vocabulary_csv(spark, paths["vocabulary"])
    events = tables.read(spark, _linked(spark, folder, paths))
    videos = jobs.build_videos(events, vocabulary, shape=(2, 2), window_hours=3, bin_hours=1)
    tables.write_tensors(videos.tensors, str(folder / "videos"))
    stored = tables.read(spark, str(folder / "videos"))
    assert rows(stored, "hadm_id", "shape") == [(100, [3, 2, 2]), (101, [3, 2, 2])]
    assert rows(videos.summary, "hadm_id", "filled_cells") == [(100, 2), (101, 2)]
    dense, stats = jobs.normalise_tensors(stored, videos.layout, shape=(2, 2), log_itemids=())
    assert stats.count() == 4
    # The mask of missing places does not change.
    before = {r["hadm_id"]: np.isnan(r["values"]) for r in stored.collect()}
    after = {r["hadm_id"]: np.isnan(r["values"]) for r in dense.collect()}
    assert all(np.array_equal(before[h], after[h]) for h in before)
    # Sodium has the values 5, 7.5 and 3.
    z = tensor.explode_tensors(dense, "hadm_id").filter("value is not null")
    x = np.array([5, 7.5, 3])
    want = sorted(np.append((x - x.mean()) / x.std(ddof=1), 0.0))
    assert [r[0] for r in z.orderBy("value").select("value").collect()] == pytest.approx(want)
    again, _ = jobs.normalise_tensors(stored, videos.layout, shape=(2, 2), stats=stats)
    assert rows(tensor.explode_tensors(again, "hadm_id")) == rows(
        tensor.explode_tensors(dense, "hadm_id"))
    only_101 = spark.createDataFrame([(101,)], "hadm_id long")
    _, fitted = jobs.normalise_tensors(stored, videos.layout, shape=(2, 2), train=only_101)
    assert fitted.agg(F.sum("count")).first()[0] == 2


def _linked(spark, folder, paths):
    jobs.ingest(spark, paths["events"], str(folder / "e"))
    jobs.ingest(spark, paths["admissions"], str(folder / "a"), mode="admissions")
    jobs.link_files(spark, str(folder / "e"), str(folder / "a"), str(folder / "l"))
    return str(folder / "l")


def test_explicit_ids_bypass_the_cohort(spark, files):
    folder, paths = files
    events = tables.read(spark, _linked(spark, folder, paths))
    ids = spark.createDataFrame([(101,), (555,)], "hadm_id long")
    videos = jobs.build_videos(events, text.read_vocabulary_csv(spark, paths["vocabulary"]),
                               shape=(2, 2), window_hours=2, hadm_ids=ids, max_specimens=9)
    assert rows(videos.summary, "hadm_id", "filled_cells", "frames_empty") == [
        (101, 2, 1), (555, 0, 2)]
    assert videos.frames.count() == 4


def test_step_profile(spark, files):
    folder, paths = files
    linked = tables.read(spark, _linked(spark, folder, paths))
    admissions = tables.read(spark, str(folder / "a"))
    out = jobs.step_profile(events=tables.read(spark, str(folder / "e")), admissions=admissions,
                            linked=linked, images=spark.createDataFrame(
        [(1, [1, 1], [0.5])], "specimen_id long, shape array<int>, values array<float>"))
    assert set(out) == {"lab_parquet", "admissions_parquet", "lab_with_adm", "lab_images"}
    assert out["lab_parquet"].first()["hadm_id_nulls"] == 1
    assert out["lab_with_adm"].first()["hadm_id_nulls"] == 0
    assert out["admissions_parquet"].first()["race_nulls"] == 1
    assert out["lab_images"].first()["n_tensors"] == 1


def test_lineage_is_cut_into_the_named_folder(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    # The setting is the cluster's own; without it a folder given to the context serves.
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            cut_lineage(df)
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    cut = cut_lineage(df)
    assert cut.agg(F.sum("x")).first()[0] == 20
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()


def test_only_what_is_asked_for_is_kept(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: kept.append(df) or df)
    events = spark.createDataFrame(
        [(1, 1, 1, 50868, at("01-01 01:00"), 1.0, at("01-01 00:00"))],
        "labevent_id long, hadm_id long, specimen_id long, itemid long, charttime timestamp_ntz, valuenum double, admittime timestamp_ntz")
    vocabulary = spark.createDataFrame([(50868, "a", "b")], "itemid long, label string, category string")
    for keep, wanted in ((False, 0), (True, 3)):
        kept.clear()
        videos = jobs.build_videos(events, vocabulary, shape=(1, 1), window_hours=2, bin_hours=1, keep=keep)
        assert len(kept) == wanted and videos.summary.first()["filled_cells"] == 1
