"""Hospital CSV files to typed tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tessera.constants import NULL_TOKENS
from tessera.sources.schemas import ADMISSIONS, EVENTS, VOCABULARY


def typed(text: DataFrame, schema: T.StructType, *, null_tokens: Iterable[str] = NULL_TOKENS
          ) -> DataFrame:
    """All-string columns to the schema's types.

    The CSV reader knows one null token only, hence this step.  A value that is neither a
    token nor of the type fails the job, whether or not the session casts strictly.
    """
    tokens = list(null_tokens)

    def strict(f: T.StructField):
        known = F.when(~F.col(f.name).isin(tokens), F.col(f.name))
        value = known.try_cast(f.dataType)
        message = F.concat(F.lit(f"CAST_INVALID_INPUT, column {f.name}: not of type {f.dataType.simpleString()}: "), known)
        return F.when(known.isNotNull() & value.isNull(), F.raise_error(message)
                      .cast(f.dataType)).otherwise(value).alias(f.name)

    return text.select(*[strict(f) for f in schema.fields])


#: How the hospital's files are written: quotes inside quotes are doubled.
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "nullValue": ""}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, n, value, quotes)``: every line with its split of the file and its place in it."""
    at = Window.partitionBy("file", "block").orderBy("_id")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counted = lines.withColumn("quotes", quotes.cast("long"))
    return counted.select("file", "block", "value", "quotes", F.row_number().over(at).alias("n"),
                          F.coalesce(F.sum("quotes").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                          .alias("quotes_before"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value, first)``: the records of CSV files whose quoted fields may hold line breaks.

    Files are read in splits as any text is.  A line goes on with a record where an odd number of
    quotes stands before it, in its split or in earlier ones of the file; one row per split carries
    that number, and where its last record began, across.  Only lines of records that do have line
    breaks are brought together.  ``first`` marks the file's first record.
    """
    lines = _lines(spark, path)
    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("_quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = totals.select("file", "block", F.coalesce(F.sum("_quotes").over(before), F.lit(0)).alias("_earlier"))
    starts = (F.col("quotes_before") + F.col("_earlier")) % 2 == 0
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(parity, ["file", "block"]).withColumn("starts", starts)
    placed = placed.withColumn("began", F.max(F.when(F.col("starts"), F.struct("block", "n"))).over(inside))
    last = placed.groupBy("file", "block").agg(F.max("began").alias("_last"))
    carried = last.select("file", "block", F.max("_last").over(before).alias("_carried"))
    at_start = (F.col("block") == 0) & (F.col("n") == 1)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    whole = placed.filter(alone).select("file", "value", at_start.alias("first"))
    parts = placed.filter(~alone).join(carried, ["file", "block"]).withColumn("began", F.coalesce("began", "_carried"))
    joined = parts.groupBy("file", "began").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts")).select(
        "file", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"),
        ((F.col("began.block") == 0) & (F.col("began.n") == 1)).alias("first"))
    return whole.union(joined).withColumn("value", F.regexp_replace("value", r"\r\z", "")).filter("value <> ''")


def _parsed(records: DataFrame, header: Sequence[str], raw: T.StructType) -> DataFrame:
    """Records as text columns; a file whose first record is not the header fails."""
    options = {k: str(v) for k, v in {**CSV_OPTIONS, "multiLine": True}.items()}
    row = F.from_csv("value", _ddl(raw), options)
    same = F.array(*[F.col("r")[c] for c in header]) == F.array(*[F.lit(c) for c in header])
    message = F.concat(F.lit("CSV header differs from the first file's in "), F.col("file"))
    data = F.when(F.col("first"), F.when(same, False).otherwise(F.raise_error(message).cast("boolean"))).otherwise(True)
    return records.withColumn("r", row).filter(data).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *,
             columns: Sequence[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """Read a CSV with header, failing on a malformed row.

    ``schema`` gives the types of known columns; further columns of the file are kept as
    text.  With ``columns`` only those are kept; rows are still checked whole.  A file of a
    folder whose header differs in names or order fails.  ``line_breaks`` allows them inside
    quotes; such files, too, are read in splits.
    """
    options = {**CSV_OPTIONS, "header": True, "multiLine": line_breaks}
    header = spark.read.csv(path, **options).columns
    types = {f.name: f for f in schema.fields}
    raw = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # Without pruning the parser checks fields that no column asks for, too.
    text = (_parsed(csv_records(spark, path), header, raw) if line_breaks else
            spark.read.schema(raw).option("columnPruning", False).csv(path, enforceSchema=False, **options))
    wanted = list(columns) if columns is not None else header
    target = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in wanted])
    return typed(text, target)


def read_events_csv(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, EVENTS, line_breaks=line_breaks)


def read_admissions_csv(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    """The five columns that linking uses or carries."""
    return read_csv(spark, path, ADMISSIONS, columns=ADMISSIONS.fieldNames(), line_breaks=line_breaks)


def read_vocabulary_csv(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    return read_csv(spark, path, VOCABULARY, line_breaks=line_breaks)
