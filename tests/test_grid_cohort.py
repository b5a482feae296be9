from conftest import at, rows
from pyspark.sql import functions as F

from tessera.constants import EXCLUDED_ITEMIDS
from tessera.operators import cohort, features, grid


def labs(spark, counts, hadm=1):
    data = [(hadm, item) for item, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "hadm_id long, itemid int")


def vocabulary(spark):
    return spark.createDataFrame(
        [(5, "e", "Blood Gas"), (4, "d", "Chemistry"), (1, "a", "Chemistry"), (2, "b", None),
         (3, "c", "Hematology"), (None, "x", "Chemistry")],
        "itemid int, label string, category string")


def test_ranking_breaks_ties_by_id(spark):
    ranked = grid.top_labs(labs(spark, {3: 2, 1: 2, 2: 5, 9: 1}), 3)
    assert rows(ranked, "rank", "itemid", "n_events") == [(1, 2, 5), (2, 1, 2), (3, 3, 2)]


def test_ranking_options(spark):
    events = labs(spark, {50934: 9, 1: 3, 2: 2}).unionByName(
        spark.createDataFrame([(None, 2)] * 5 + [(2, 7)] * 4, "hadm_id long, itemid int"))
    assert rows(grid.top_labs(events, 9, exclude=EXCLUDED_ITEMIDS), "rank", "itemid") == [
        (1, 2), (2, 7), (3, 1)]
    linked = grid.top_labs(events, 9, exclude=EXCLUDED_ITEMIDS, linked_only=True)
    assert rows(linked, "rank", "itemid") == [(1, 7), (2, 1), (3, 2)]
    members = spark.createDataFrame([(1,)], "hadm_id long")
    assert rows(grid.top_labs(events, 9, cohort=members), "rank", "itemid") == [
        (1, 50934), (2, 1), (3, 2)]


def test_layout_is_by_category_then_id_with_nulls_last(spark):
    ranked = grid.top_labs(labs(spark, {1: 5, 2: 4, 3: 3, 4: 2, 5: 1, 8: 9}), 10)
    layout = grid.layout_for(ranked, vocabulary(spark), (2, 3))
    assert rows(layout, "index", "row", "col", "itemid") == [
        (0, 0, 0, 5), (1, 0, 1, 1), (2, 0, 2, 4), (3, 1, 0, 3), (4, 1, 1, 2)]
    assert rows(grid.missing_from_vocabulary(ranked, vocabulary(spark)), "itemid") == [(8,)]
    by_rank = grid.layout_for(ranked, vocabulary(spark), (2, 2), by_category=False)
    assert rows(by_rank, "index", "itemid") == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_layout_is_cut_after_the_category_sort(spark):
    ranked = grid.top_labs(labs(spark, {2: 9, 3: 8, 5: 1}), 3)
    assert rows(grid.layout_for(ranked, vocabulary(spark), (1, 2)), "itemid") == [(3,), (5,)]


def test_types_without_a_place_are_reported_with_the_reason(spark):
    ranked = grid.top_labs(labs(spark, {2: 9, 3: 8, 5: 1, 8: 5}), 4)
    layout = grid.layout_for(ranked, vocabulary(spark), (1, 2))
    assert rows(grid.left_out(ranked, layout, vocabulary(spark)), "itemid", "rank", "reason") == [
        (2, 1, "no place"), (8, 3, "not in vocabulary")]
    best = grid.layout_for(ranked, vocabulary(spark), (1, 2), best_ranks=True)
    assert rows(best, "itemid") == [(2,), (3,)]
    assert rows(grid.left_out(ranked, best, vocabulary(spark)), "itemid", "reason") == [
        (5, "no place"), (8, "not in vocabulary")]


def test_layout_is_a_bijection(spark):
    layout = grid.layout_of_vocabulary(vocabulary(spark), (3, 3))
    assert layout.count() == 5
    assert layout.select("row", "col").distinct().count() == 5
    assert layout.filter("index != row * 3 + col").count() == 0
    by_id = grid.layout_of_vocabulary(vocabulary(spark), (3, 3), by_category=False)
    assert rows(by_id, "index", "itemid") == [(i, i + 1) for i in range(5)]


def test_categories_in_layout_order(spark):
    out = grid.layout_by_category(grid.layout_of_vocabulary(vocabulary(spark), (3, 3)))
    assert rows(out, "first_index", "category", "n_cells", "itemids") == [
        (0, "Blood Gas", 1, [5]), (1, "Chemistry", 2, [1, 4]), (3, "Hematology", 1, [3]),
        (4, "(no category)", 1, [2])]


def stays(spark):
    """Admission 1: three specimens, the last after a day; 2: one specimen; 3: none."""
    data = [(1, 10, 1, at("01-01 01:00")), (1, 10, 2, at("01-01 02:00")),
            (1, 11, 1, at("01-01 03:00")), (1, 12, 1, at("01-03 00:00")),
            (2, 20, 1, at("01-01 05:00")), (3, None, 1, at("01-01 06:00")),
            (None, 40, 1, at("01-01 06:00")), (4, 50, 1, at("01-02 00:00"))]
    return spark.createDataFrame(
        data, "hadm_id long, specimen_id long, itemid int, charttime timestamp_ntz").withColumn(
        "admittime", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))


def test_whole_stay_and_in_window_specimen_limits_differ(spark):
    assert rows(cohort.specimens_per_admission(stays(spark), at_most=2)) == [(2, 1), (4, 1)]
    assert rows(cohort.specimens_per_admission(stays(spark), at_least=2)) == [(1, 3)]
    ranked = cohort.in_window_ranking(stays(spark), window_hours=24, max_specimens=2)
    assert rows(ranked) == [(1, 3, 2), (2, 1, 1)]
    assert rows(cohort.in_window_ranking(stays(spark), window_hours=24, top=1)) == [(1, 3, 2)]
    assert rows(cohort.in_window_ranking(stays(spark), window_hours=24, min_specimens=2),
                "hadm_id") == [(1,)]


def test_top_admissions(spark):
    assert rows(cohort.top_admissions(stays(spark), top=2)) == [(1, 4, 2, 3, 4), (2, 1, 1, 1, 4)]
    first_day = cohort.top_admissions(stays(spark), top=9, first_hours=24)
    assert rows(first_day) == [(1, 3, 2, 2, 3), (2, 1, 1, 1, 3), (3, 1, 1, 0, 3)]


def test_subset_overview(spark):
    subset = cohort.specimens_per_admission(stays(spark), at_most=23)
    out = cohort.subset_overview(subset, stays(spark)).first()
    assert (out["n_admissions"], out["median_specimens"], out["max_specimens"],
            out["total_admissions"], out["pct_of_all"]) == (3, 1.0, 3, 4, 75.0)


def test_splits(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 20).alias("subject_id"),
                                (F.col("id") % 4).alias("site"))
    out = features.split_by_subject(df, seed=None)
    assert out.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter(
        "n > 1").count() == 0
    assert rows(out.groupBy("split").count()) == [("test", 4), ("train", 32), ("validation", 4)]
    rest, held_out = features.leave_site_out(df, "site", 2)
    assert (rest.count(), held_out.count()) == (30, 10)
    assert rows(features.site_folds(df, "site"), "n_test", "n_train", "pct_test") == [
        (10, 30, 25.0)] * 4


def test_harmonised_units(spark):
    events = spark.createDataFrame([(1, 10, 2.0), (2, 11, 5.0), (3, 99, 1.0)],
                                   "event_id long, itemid int, valuenum double")
    mapping = spark.createDataFrame([(10, 1, 18.0, 0.0), (11, 2, 1.0, 32.0)],
                                    "itemid int, concept_id int, factor double, shift double")
    out = features.harmonise(events, mapping)
    assert rows(out, "event_id", "itemid", "valuenum") == [(1, 1, 36.0), (2, 2, 37.0)]
    other = spark.createDataFrame([(2,), (3,), (None,)], "itemid int")
    assert rows(features.shared_concepts(out, other)) == [(2,)]
