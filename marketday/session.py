"""Session settings, and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the jobs rely on.  Hot join keys are split by AQE; the force flag lets it
# split one even where an aggregation above the join would otherwise reuse the join's partitioning
# (Spark then adds the missing shuffle, and only when it really found a skewed partition).
# A shuffled join of over 10 GB of lines with a window of headers drops lines by a bloom filter before their shuffle.
# Spark would build it only from a table below 10 MB in all its days, which no header table is; a scan of the
# window's ids costs little.  The filter takes 8 MB whatever the data: by the formula one in 3 000 other lines passes it with
# four million orders in the window, one in 26 with eight million, half of them with sixteen million; beyond that it is of no use.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
}


# What AQE lets a task read of a shuffle, at most.  Facts have nearly as many groups as lines, and a task that joins and
# groups lines holds each of them three times in memory, some 35 times the shuffled bytes.
ADVISORY, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session; a smaller size of a task's share stays."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, f"{TASK_BYTES}b")
    return spark


def local_session(app: str = "marketday", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def own_folder(spark: SparkSession) -> None:
    """A work folder for a single machine where none is set; tests, the bench and the registered queries ask for it."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") and not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketday-"))


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one folder that this job has written."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df, label: str):
    """Write a frame below the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor; used where a frame feeds several jobs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
