"""What several operators share: tables, materialising, slices of Arrow batches."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset a local session, as in tests, gets
    one of its own; on a cluster that would be a folder which executors can't see, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return own_folder(spark.conf.get("spark.master"), spark.sparkContext.applicationId)
    return folder


@functools.cache
def own_folder(master: str, application: str) -> str:
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{application}-")


def stored(df: DataFrame) -> DataFrame:
    """As ``materialize`` for large results: a compressed table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of steps whose result is materialised.

    They are dropped once the driver has collected its garbage, which may otherwise be late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column's text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def least_by_hash(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the least hashes of a column, so that each value is as likely to be taken.

    A limit alone would send up to ``limit`` rows of every task to one; the threshold on the hash,
    from a count of the values, leaves about twice the limit in all.
    """
    number = rows.agg(F.approx_count_distinct(column)).first()[0]
    h = F.xxhash64(column)
    if number > 2 * limit:
        share = (2.0 * limit + 100) / number
        rows = rows.filter(h < F.lit(int(-(2 ** 63) + share * 2 ** 64) if share < 1 else 2 ** 63 - 1))
    return rows.orderBy(h, column).limit(limit)


def spare(taken: Iterable[str], name: str) -> str:
    """A column name that ``taken`` does not have, in any case of letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def large_binary(column: pa.Array) -> pa.Array:
    """Text as bytes with 64-bit offsets; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``SLICE_ROWS`` rows whose texts together have at most ``limit`` bytes; a
    longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, rows)
        yield batch.slice(at, end - at)
        at = end
