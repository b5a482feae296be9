"""JSON artefacts: grid layout, normalisation statistics, metadata, step statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.schemas import LAYOUT, STATS_REPORT


def write_json(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """JSON lines; ``one_file`` is for reports of a few rows only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_layout(layout: DataFrame, path: str) -> None:
    """Grid layout in index order; at most H·W rows."""
    write_json(layout.orderBy("index"), path, one_file=True)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout as JSON lines or as one JSON array."""
    return _read_json(spark, path, LAYOUT)


def _read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines or whole documents of a schema; what fits neither fails.

    A line that is a whole record marks JSON lines; anything else that opens the file is the
    start of a document that spans lines, or of an array.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    opening = first[0].strip() if first else ""
    lines = opening.startswith("{") and opening.endswith("}")
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def read_stats_report(spark: SparkSession, path: str) -> DataFrame:
    """Saved statistics as one row per channel.

    Saved means and deviations are rounded; use the Parquet table for full precision.
    """
    saved = _read_json(spark, path, STATS_REPORT)
    return saved.select(F.explode("labs").alias("lab")).select("lab.*")
