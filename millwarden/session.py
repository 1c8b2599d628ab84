"""Session helpers: local test session, shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench, with a shared folder of its own; a cluster brings both."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millwarden")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", own_folder())
        .getOrCreate()
    )


def own_folder() -> str:
    """A fresh folder of this machine, for sessions that have no other machine."""
    folder = Path(os.environ.get("MILLWARDEN_SCRATCH", "/tmp")) / f"millwarden-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return str(folder)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a session within one process gets a folder of its own; on a cluster it is an error, as each executor
    would write to its own disk.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = own_folder()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor re-reads it."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._stage = path
    return written


def drop_stage(df: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote for ``df``, once nothing that reads it is still to run."""
    delete_stage(df.sparkSession, df._stage)


def delete_stage(spark: SparkSession, path: str) -> None:
    """Remove a stage of ``scratch_path`` that nothing reads any more."""
    if not path.startswith(shared_folder(spark).rstrip("/")):
        raise ValueError("only stages below the shared folder are removed")
    remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folders_in(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders in ``path`` that hold a file of that name; none where ``path`` does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found = [status.getPath() for status in system.listStatus(at) if status.isDirectory()]
    return [f.getName() for f in found if system.exists(hadoop.Path(f, holding))]
