"""Explicit schemas of the hospital tables and of the stored artefacts."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("labevent_id", T.LongType()),
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("specimen_id", T.LongType()),
    T.StructField("itemid", T.IntegerType()),
    T.StructField("charttime", T.TimestampNTZType()),
    T.StructField("value", T.StringType()),
    T.StructField("valuenum", T.DoubleType()),
    T.StructField("ref_range_lower", T.DoubleType()),
    T.StructField("ref_range_upper", T.DoubleType()),
])

ADMISSIONS = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("admittime", T.TimestampNTZType()),
    T.StructField("edregtime", T.TimestampNTZType()),
    T.StructField("race", T.StringType()),
])

VOCABULARY = T.StructType([
    T.StructField("itemid", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("fluid", T.StringType()),
    T.StructField("category", T.StringType()),
])

LAYOUT = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("itemid", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("category", T.StringType()),
])

STATS_REPORT = T.StructType([
    T.StructField("clip_range", T.ArrayType(T.DoubleType())),
    T.StructField("n_labs", T.LongType()),
    T.StructField("n_log_transformed", T.LongType()),
    T.StructField("labs", T.ArrayType(T.StructType([
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("itemid", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("log_transform", T.BooleanType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("count", T.LongType()),
    ]))),
])
