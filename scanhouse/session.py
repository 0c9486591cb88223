"""Session helpers: a local session for tests/bench, and the shared scratch folder.

On a cluster the session comes from the user (spark-submit, notebook); nothing here
overrides its settings. ``scratch_dir`` reads ``spark.checkpoint.dir`` — the shared
folder the cluster names — and only invents one for a local master where it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scanhouse") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast only what was measured small at runtime, never on a static estimate
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCANHOUSE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a private one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{_CHECKPOINT_KEY} is not set; on a cluster it must name a shared folder (HDFS/S3/...)"
        )
    path = tempfile.mkdtemp(prefix="scanhouse-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever store it lies."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that run inside drop their shuffle files when they end, not when the driver happens to collect
    its garbage. Not for a DataFrame that is collected here and used again."""
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)


def write_scratch(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as compressed parquet to a scratch folder, and read back: lineage ends here. What a
    checkpoint writes is not compressed, and text repeats itself."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder under the shared checkpoint folder, unique per call."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{purpose}-{uuid.uuid4().hex}"
