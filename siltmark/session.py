"""Session defaults for local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, UTC, adaptive execution on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SILTMARK_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. Only a session on one machine gets a temporary one where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="siltmark-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver find the shuffles and checkpoints that nothing refers to any more, so that executors delete their files now and not when its memory next runs full.

    Python's objects are given up in the background, so the driver looks twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders, wherever Spark can reach them; those that are not there are passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str, rows: int = 20_000) -> DataFrame:
    """The rows dealt over the cluster by keys, about so many a task. For small rows of which each becomes much: a short file of them is read by one task, which would do all that follows."""
    n = df.count()
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // 200), -(-n // rows))
    return df.repartition(parts, *by)


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a context; needed where they cannot import it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_siltmark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltmark-")) / "siltmark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"siltmark/{p.relative_to(root)}")
    context.addPyFile(str(archive))
    context._siltmark_shipped = True
