"""Session settings and the one way this package cuts lineage.

Iterative operators write their intermediate tables to the shared folder named
by ``spark.checkpoint.dir`` so that a lost executor never loses work.
"""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "framelore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    On a cluster pass only site settings; ``spark.sql.shuffle.partitions`` is
    left to the caller because AQE coalesces from whatever is set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives the package to the executors, once a session: their Python need not have it on its path."""
    context = spark.sparkContext
    if getattr(context, "_framelore_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="framelore-package-"), "framelore.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._framelore_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from the session. Only a local session may fall back to a temporary
    folder: on a cluster a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="framelore-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """This application's own sub-folder of the shared folder; it is deleted when the application ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/framelore-{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_framelore_run", False):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        spark.sparkContext._framelore_run = True
    return path


def materialise(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write once, read back: cuts lineage and gives the next plan real sizes."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
