"""Readers on files that are not as clean as the test tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from tessera.functions.ordered import order_key, rank_key
from tessera.operators import cells, cohort, features, meta, profile
from tessera.plans import jobs
from tessera.sources import reports, tables, text

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()),
                       T.StructField("c", T.LongType())])


@pytest.fixture()
def file(tmp_path):
    def write(content: str, name: str = "x.csv") -> str:
        (tmp_path / name).write_text(content)
        return str(tmp_path)

    return write


def test_doubled_quotes_and_line_breaks(spark, file):
    path = file('a,b,c\n1,"said ""a, b"" twice",2\n')
    assert [tuple(r) for r in text.read_csv(spark, path, SCHEMA).collect()] == [(1, 'said "a, b" twice', 2)]
    path = file('a,b,c\n1,"two\nlines",2\n')
    rows = text.read_csv(spark, path, SCHEMA, line_breaks=True).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", 2)]


def test_files_of_other_column_order_fail(spark, file):
    file("a,b,c\n1,x,2\n")
    path = file("c,b,a\n1,x,2\n", "y.csv")
    with pytest.raises(Exception):
        text.read_csv(spark, path, SCHEMA).collect()


def test_short_rows_fail_also_where_columns_are_chosen(spark, file):
    path = file("a,b,c\n1,x\n")
    with pytest.raises(Exception):
        text.read_csv(spark, path, SCHEMA, columns=["a"]).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_value_of_another_type_fails(spark, file, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="column a: not of type bigint: x"):
            text.read_csv(spark, file("a,b,c\nx,y,2\n"), SCHEMA).collect()
        rows = text.read_csv(spark, file("a,b,c\n___,NA,\n"), SCHEMA).collect()
        assert [tuple(r) for r in rows] == [(None, None, None)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


@pytest.mark.parametrize("content", [
    '[ {"index": 0, "row": 0, "col": 0, "itemid": 7},\n {"index": 1, "row": 0, "col": 1, "itemid": 8} ]',
    '\n[\n{"index": 0, "row": 0, "col": 0, "itemid": 7}, {"index": 1, "row": 0, "col": 1, "itemid": 8}]',
    '{"index": 0, "row": 0, "col": 0, "itemid": 7}\n{"index": 1, "row": 0, "col": 1, "itemid": 8}\n'])
def test_layouts_in_any_form(spark, file, content):
    path = file(content, "layout.json")
    rows = reports.read_layout(spark, path).collect()
    assert sorted((r.itemid, r.col) for r in rows) == [(7, 0), (8, 1)]


def test_a_layout_that_is_no_json_fails(spark, file):
    with pytest.raises(Exception):
        reports.read_layout(spark, file("index,row\n0,1\n", "layout.json")).collect()


def test_exists_takes_globs(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "linked-1"))
    assert tables.exists(spark, str(tmp_path / "linked-*"))
    assert not tables.exists(spark, str(tmp_path / "other-*"))
    assert tables.read_events(spark, linked=str(tmp_path / "linked-*"), raw="nowhere").count() == 3


def test_rank_key_orders_like_the_struct(spark):
    times = [None, "1969-12-31 23:59:59.999999", "2024-01-01", "2024-01-01 00:00:00.000001", "9999-12-31"]
    ties = [None, -2**63, -1, 0, 5, 2**63 - 1]
    df = spark.createDataFrame([(t, i) for t in times for i in ties], "t string, i bigint").select(
        F.col("t").cast("timestamp_ntz").alias("t"), "i")
    by_struct = [tuple(r) for r in df.orderBy(order_key("t", ("i",))).collect()]
    assert by_struct == [tuple(r) for r in df.orderBy(rank_key(df, "t", ("i",))).collect()]
    assert df.filter(rank_key(df, "t", ("i",)).isNull()).count() == 0


def test_reports_show_empty_bins_and_buckets(spark):
    values = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    rows = profile.histogram(values, "v", bins=5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 0, 1] and rows[1].bin_low == 2.0
    assert profile.histogram(values.limit(0), "v", bins=5).count() == 0
    stays = spark.createDataFrame([(1, 5.0, 3, 4)], "hadm_id int, hours double, n_specimens long, n_labs long")
    found = {r.bucket: (r.n_admissions, r.median_labs) for r in profile.duration_buckets(stays).collect()}
    assert len(found) == 5 and sorted(found.values(), key=str) == [(0, None)] * 4 + [(1, 4.0)]


def test_stored_specimens_below_the_first_ones_are_found(spark):
    events = spark.createDataFrame([(s, i) for s in range(9) for i in range(20 - s)],
                                   "specimen_id int, itemid int")
    stored = spark.createDataFrame([(7,), (8,)], "specimen_id int")
    assert [r.specimen_id for r in profile.rich_specimens(events, top=1, having_tensor=stored).collect()] == [7]


def test_windows_with_gaps_and_other_time_zero(spark):
    day = datetime(2024, 1, 2)
    events = spark.createDataFrame(
        [(1, 5, 9, datetime(2024, 1, 2, 18), day, datetime(2024, 1, 2, 10), 1.0)],
        "hadm_id int, specimen_id int, itemid int, charttime timestamp_ntz, admittime timestamp_ntz, "
        "edregtime timestamp_ntz, valuenum double")
    layout = spark.createDataFrame([(9, 0, 0)], "itemid int, row int, col int")
    assert features.sliding_windows(events, layout, window_hours=12, stride_hours=24, bin_hours=1).count() == 0
    assert features.sliding_windows(events, layout, window_hours=20, stride_hours=24, bin_hours=1).count() == 1
    late = events.withColumn("admittime", F.expr("charttime + INTERVAL 1 HOUR"))
    assert cohort.in_window_ranking(late).count() == 0
    assert cohort.in_window_ranking(late, anchor="edregtime").count() == 1
    with pytest.raises(ValueError):
        meta.members(events, n_bins=0)


def test_step_profiles_share_a_schema(spark, tmp_path):
    spark.range(4).withColumnRenamed("id", "hadm_id").write.parquet(str(tmp_path / "one"))
    spark.range(2).write.parquet(str(tmp_path / "two"))
    steps = {n: tables.read(spark, str(tmp_path / n)) for n in ("one", "two")}
    rows = {r.step: r for r in jobs.step_profiles(steps, sizes=True).collect()}
    assert rows["one"].nulls == {"hadm_id": 0} and rows["two"].nulls == {}
    assert rows["one"].column_names == ["hadm_id"] and rows["two"].size_mb > 0 and rows["one"].n_files > 0


def csv_file(path, n, seed, newline):
    """Rows with quotes, separators and line breaks inside quotes, some of them long."""
    rng = random.Random(seed)
    records = []
    for i in range(n):
        note = "".join(rng.choices(['a', 'b c', ',', '\n', '"', newline, 'é', "x" * 90, '\n\n'], k=rng.choice((0, 1, 1, 3, 9, 40))))
        records.append((str(i), note, rng.choice(("", "z"))))
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if rng.random() < 0.2 or set(v) & set('",\n\r') else v
    text = newline.join([",".join(map(quoted, r)) for r in [("id", "no,te", "flag"), *records]])
    path.write_bytes((text.replace("id,", "id,", 1) + newline).encode())
    return {(i, note or None, flag or None) for i, note, flag in records}


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_line_breaks_in_quotes_are_read_in_splits(spark, tmp_path, newline, split):
    want = csv_file(tmp_path / "a.csv", 150, 1, newline) | csv_file(tmp_path / "b.csv", 40, 2, newline)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        schema = T.StructType([T.StructField("id", T.LongType())])
        got = text.read_csv(spark, str(tmp_path), schema, line_breaks=True)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((int(i), *rest)) for i, *rest in want)
        if split == "1000":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)


def test_files_with_another_header_or_broken_rows_fail(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    (tmp_path / "a.csv").write_text('id,note\n1,"a\nb"\n')
    assert text.read_csv(spark, str(tmp_path), schema, line_breaks=True).collect() == [(1, "a\nb")]
    (tmp_path / "b.csv").write_text("note,id\nx,2\n")
    with pytest.raises(Exception, match="header differs"):
        text.read_csv(spark, str(tmp_path), schema, line_breaks=True).collect()
    (tmp_path / "b.csv").write_text("id,note\n2,y,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_csv(spark, str(tmp_path), schema, line_breaks=True).collect()


@pytest.mark.parametrize("window, stride, bins", [(240, 120, 10), (60, 120, 10), (48, 7, 3), (50, 24, 4), (5, 5, 2.5)])
def test_panes_give_the_cells_of_every_window(spark, window, stride, bins):
    rng = random.Random(6)
    start = datetime(2020, 1, 1)
    data = [(i, i % 3, rng.choice([1, 2, 9]), start + timedelta(minutes=rng.randint(-600, 20_000)),
             rng.choice([None, float("nan"), float(i)]), start) for i in range(800)]
    events = spark.createDataFrame(data, "event_id long, hadm_id long, itemid long, charttime timestamp_ntz, "
                                         "valuenum double, admittime timestamp_ntz")
    layout = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "itemid long, row int, col int")
    size = {"window_hours": window, "stride_hours": stride, "bin_hours": bins}
    keys = ["hadm_id", "window_start", "time_bin", "row", "col"]
    want = cells.last_cells(features.sliding_windows(events, layout, **size), keys=keys).select(*keys, "value")
    out = features.sliding_cells(events, layout, **size)
    assert sorted(out.select(*keys, "value").collect()) == sorted(want.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Windows repeat panes, which are aggregates already.
    assert plan.index("Generate explode") < plan.rindex("Aggregate")
