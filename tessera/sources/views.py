"""The driver's tables seen as laboratory events.

EV: one long stay per user; EB: many admissions per user; LI: wide vocabulary, short
stays; VOC and PARTS: the vocabularies.  All rows of the tables are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.lookups import join_by_key

EV_WINDOW_HOURS, EV_BIN_HOURS, EV_BINS = 720, 30, 24
LI_WINDOW_HOURS, LI_BIN_HOURS, LI_BINS = 51_840, 2_160, 24
EV_SHAPE = (8, 8)
EV_EXCLUDED = (1000, 1001)
# Every fifth of the 100 types is treated as skewed.
EV_LOGGED = tuple(range(1000, 1100, 5))
LI_TIEBREAK = ("l_linenumber", "valuenum", "l_suppkey", "l_extendedprice")


# The columns the views use; given to the reader so that no job is spent on footers.
_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_type string",
    "customer": "c_custkey bigint, c_nationkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def k_of_props() -> Column:
    """The number in ``{"k": 12}``."""
    return F.regexp_extract("props", "[0-9]+", 0).try_cast("int")


def ev_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV without the admission time."""
    k = F.col("k")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").withColumn("k", k_of_props()).select(
        "event_id", F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
        (F.col("user_id") * 1000 + day).alias("specimen_id"),
        F.col("ts").alias("charttime"), (k + 1000).alias("itemid"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("valuenum"),
        F.when(k % 4 != 0, 10.0).alias("ref_range_lower"),
        F.when(k % 4 != 0, 90.0).alias("ref_range_upper"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev_raw(spark, sf_dir)
    admissions = events.groupBy("hadm_id").agg(F.min("charttime").alias("admittime"))
    return join_by_key(events, admissions, "hadm_id")


def eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    signup = F.col("event_type") == "signup"
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("subject_id"),
        F.when(signup, F.col("event_id")).alias("hadm_id"),
        (F.col("user_id") * 1000 + day).alias("specimen_id"),
        F.col("ts").alias("charttime"), (k_of_props() + 1000).alias("itemid"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("valuenum"))


def eb_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
            .select(F.col("event_id").alias("hadm_id"), F.col("ts").alias("admittime")))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        (F.col("l_orderkey") * 100_000 + F.col("l_suppkey")).alias("specimen_id"),
        F.col("l_partkey").alias("itemid"), F.col("l_quantity").alias("valuenum"),
        F.col("l_shipdate").alias("charttime"), "l_linenumber", "l_suppkey", "l_extendedprice")
    return lines.join(orders, "hadm_id")


def voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of EV; three types are missing on purpose."""
    k = F.col("k")
    category = (F.when(k % 10 == 9, F.lit(None)).when(k % 3 == 0, "Blood Gas")
                .when(k % 3 == 1, "Chemistry").otherwise("Hematology"))
    return (table(spark, sf_dir, "events").select(k_of_props().alias("k")).distinct()
            .filter(k < 97)
            .select((k + 1000).alias("itemid"), F.concat(F.lit("lab_"), k.cast("string"))
                    .alias("label"), category.alias("category")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of LI."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"),
        F.col("p_type").alias("category"))
