"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else made.
_RUNTIME_CONF = {
    # Timestamps without zone are compared and subtracted as UTC wall clock.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot admission or subject is split over many tasks in a sort-merge join,
    # also where the split costs the following aggregation one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# What a task reads of a shuffle, in compressed bytes.  Ids shrink to about a tenth there, and a task
# holds their rows once for each sort and aggregate, so Spark's 64 MB become 2 GB of memory.
_TASK_BYTES_KEY, _TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; broadcast thresholds and smaller tasks stay the cluster's own."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(_TASK_BYTES_KEY)) > size(_TASK_BYTES):
        spark.conf.set(_TASK_BYTES_KEY, _TASK_BYTES)
    return spark


def local_session(cores: int | str = 8, *, app: str = "tessera") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that ``spark.checkpoint.dir`` must name."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("spark.checkpoint.dir names no folder to keep results in")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
