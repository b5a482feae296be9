"""Every registered query against its SQL oracle, and rules its plan must keep."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tessera.functions.lookups import lookup
from tessera.operators import cohort, link
from tessera.plans import queries as q
from tessera.sources import views
from tools.check_oracles import differences, tables

SF = "/root/testdata/sf0.001"
NAMES = sorted(q.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


def test_every_query_has_an_oracle():
    assert set(q.QUERIES) == set(contract.oracle_sql()) & set(q.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                     "BroadcastNestedLoopJoin"):
        assert operator not in plan
    assert differences(df.toPandas(), duck.execute(contract.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_run(df) -> int:
    """Shuffles of the plan that was run, without those that were used again."""
    df._jdf.collectToPython()
    final = plan_of(df).split("+- == Initial Plan ==")[0]
    return len(re.findall(r"^[ :+*-]*Exchange ", final, re.MULTILINE))


def test_percentiles_run_few_shuffles(spark):
    # Two make the profile; the others count intervals, place them, and count and sort what is left.
    assert shuffles_run(q.QUERIES["dist_summary_admission"](spark, SF)) <= 6


def scans_run(df, column: str) -> int:
    final = plan_of(df).split("+- == Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet \[[^\]]*{column}", final))


@pytest.mark.parametrize("name, most", [("video_summary", 6), ("frame_metadata", 6), ("run_summary", 8),
                                        ("frame_documents", 8)])
def test_products_of_videos_share_one_pass(spark, name, most):
    df = q.QUERIES[name](spark, SF)
    assert shuffles_run(df) <= most
    # Only one scan reads the values; types are ranked, named and anchored without them.
    assert scans_run(df, "value#") == 1 and scans_run(df, "#") <= 4


@pytest.mark.parametrize("name", ["dataset_totals", "table_profile"])
def test_totals_copy_no_rows(spark, name):
    assert "Expand" not in plan_of(q.QUERIES[name](spark, SF))


def test_scan_reads_only_needed_columns_and_filters_early(spark):
    plan = plan_of(q.QUERIES["binned_last_value"](spark, SF))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert all("customer" not in s for s in scans) and min(len(s.split(",")) for s in scans) == 1
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(user_id)" in plan


@pytest.fixture()
def small_splits(spark):
    """Joins are shuffled and partitions above 20 kB count as skewed."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    yield
    for k, value in old.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture()
def own_task_bytes(spark):
    """The size of tasks is the test's own, and shuffles have more parts than the session has cores."""
    old = {k: spark.conf.get(k, None) for k in (TASK_BYTES, "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    for k, value in old.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


@pytest.mark.parametrize("given", [None, "64MB", "1g"])
def test_tasks_read_small_parts_of_a_shuffle(own_task_bytes, given):
    spark = own_task_bytes
    spark.conf.unset(TASK_BYTES) if given is None else spark.conf.set(TASK_BYTES, given)
    q.QUERIES["grid_sweep_admission"](spark, SF)
    # Some 160 MB of ids that do not compress: with 64 MB a task they meet in one part per core.
    ids = spark.range(8_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    assert ids.repartition("a").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("given", ["20k", "8388608", "16m"])
def test_smaller_parts_stay_the_clusters_own(own_task_bytes, given):
    own_task_bytes.conf.set(TASK_BYTES, given)
    q.QUERIES["grid_sweep_admission"](own_task_bytes, SF)
    assert own_task_bytes.conf.get(TASK_BYTES) == given


@pytest.mark.parametrize("name", [
    "grid_sweep_admission",
    "top_admissions",
    "dist_summary_admission",
    "duration_buckets",
    "sampling_frequency",
    "subset_admission_stats",
    "subset_overview",
    "cohort_by_specimens",
    "cohort_in_window",
    "lab_coverage",
])
def test_queries_on_stays_lower_the_size_of_tasks(own_task_bytes, name):
    own_task_bytes.conf.set(TASK_BYTES, "64MB")
    q.QUERIES[name](own_task_bytes, SF)
    assert own_task_bytes.conf.get(TASK_BYTES) == "16m"


def hot_events(spark, column: str):
    """Events of which two thirds share one key, from several map tasks as in any large table."""
    hot = F.when(F.col("event_id") % 3 > 0, 7).otherwise(F.col(column)).cast("long")
    events = views.eb(spark, "/root/testdata/sf0.01").repartition(8, "event_id")
    return events.withColumn(column, hot)


def runs_split(df) -> bool:
    df._jdf.collectToPython()
    return "skew=true" in plan_of(df)


def test_hot_subject_is_split_at_run_time(spark, small_splits):
    admissions = views.eb_admissions(spark, "/root/testdata/sf0.01")
    assert runs_split(link.link_events(hot_events(spark, "subject_id"), admissions))


def test_hot_admission_is_split_at_run_time(spark, small_splits):
    events = hot_events(spark, "hadm_id")
    # One row per admission, aggregated by the join key just before the join.
    first = events.groupBy("hadm_id").agg(F.min("charttime").alias("admittime"))
    assert runs_split(link.attach_admissions(events, first))
    assert runs_split(cohort.keep_cohort(events, first))


def test_lookup_keeps_every_row(spark):
    events = views.eb(spark, SF)
    out = lookup(events, views.eb_admissions(spark, SF), "hadm_id", spread_by=("event_id",))
    assert out.count() == events.count()


@pytest.mark.parametrize("name", ["binned_last_value", "frame_metadata", "specimen_cells",
                                  "link_events", "specimen_gaps", "backfill_hadm_next"])
def test_ordered_aggregates_hash_and_do_not_sort(spark, name):
    assert "SortAggregate" not in plan_of(q.QUERIES[name](spark, SF))
