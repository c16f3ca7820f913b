"""Session helpers: tuned defaults for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("phenospark")
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only when the session itself runs in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="phenospark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage by writing a Parquet table into the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


RELEASE_SECONDS = 5.0
_released = time.monotonic()


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished plans are gone, so their shuffle files go now; small steps share one look."""
    global _released
    if time.monotonic() - _released > RELEASE_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that it need not be installed on them."""
    context = spark.sparkContext
    if getattr(context, "_phenospark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="phenospark-ship-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = os.path.join(folder, "copy")
    shutil.copytree(os.path.join(root, "phenospark"), os.path.join(copy, "phenospark"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "phenospark"), "zip", copy))
    context._phenospark_shipped = True
