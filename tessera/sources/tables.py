"""Parquet tables: event, admission, tensor and cell datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """One or several Parquet paths (files, folders or globs) as one table."""
    return spark.read.parquet(path, *more)


def write(df: DataFrame, path: str, *, compression: str = "zstd", mode: str = "overwrite") -> None:
    """Write Parquet; Spark sizes the output files from the data."""
    df.hint("rebalance").write.mode(mode).option("compression", compression).parquet(path)


def write_linked(df: DataFrame, path: str, *, compression: str = "snappy",
                 mode: str = "overwrite") -> None:
    """Write events ordered by subject and time across files.

    The range includes the time, so that one subject's history may span many files.
    """
    (df.repartitionByRange("subject_id", F.col("charttime").asc_nulls_last())
     .sortWithinPartitions("subject_id", F.col("charttime").asc_nulls_last())
     .write.mode(mode).option("compression", compression).parquet(path))


def write_tensors(df: DataFrame, path: str, *, per_file: int = 100_000,
                  mode: str = "overwrite") -> None:
    """One dataset of ``(id, shape, values)`` rows; files are cut by row count."""
    (df.hint("rebalance").write.mode(mode).option("compression", "zstd")
     .option("maxRecordsPerFile", per_file).parquet(path))


def tensor_ids(tensors: DataFrame, id_col: str) -> DataFrame:
    """Stored ids in numeric order."""
    return tensors.select(id_col).orderBy(id_col)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a glob matches, is there on the file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_events(spark: SparkSession, *, linked: str | None, raw: str) -> DataFrame:
    """Linked events when they have been written, else the raw events."""
    return read(spark, linked if linked and exists(spark, linked) else raw)


def specimen_events(events: DataFrame, specimen_id: int) -> DataFrame:
    """All events of one specimen; the id filter reaches the Parquet scan."""
    wanted = [c for c in ("specimen_id", "subject_id", "hadm_id", "charttime", "admittime",
                          "itemid", "valuenum", "value", "ref_range_lower", "ref_range_upper")
              if c in events.columns]
    return events.filter(F.col("specimen_id") == specimen_id).select(*wanted)


def in_event_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("charttime").asc_nulls_last(), F.col("itemid").asc_nulls_last())


def dataset_size(df: DataFrame) -> DataFrame:
    """Files and megabytes behind a file-based table."""
    files = df.select(F.col("_metadata.file_path").alias("path"),
                      F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"),
                     (F.sum("size") / F.lit(1024.0 * 1024.0)).alias("size_mb"))
