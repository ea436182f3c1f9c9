"""Where intermediate tables and checkpoints live."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_NAMED: dict[str, str] = {}


def use_folder(folder: str | None) -> None:
    """Name the shared folder for sessions that leave ``spark.checkpoint.dir`` unset."""
    _NAMED.clear()
    if folder:
        _NAMED["folder"] = folder


def is_named(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or _NAMED)


def ensure_named(spark: SparkSession) -> None:
    """For entry points: name a folder where the session leaves it unset, as on a single machine.

    The environment variable ACCORDANT_SHARED names it, or else it is a new temporary folder.
    """
    if not is_named(spark):
        use_folder("file://" + (os.environ.get("ACCORDANT_SHARED") or tempfile.mkdtemp(prefix="accordant-")))


def shared_root(spark: SparkSession) -> str:
    """The folder of this application's tables, below the one ``spark.checkpoint.dir`` names.

    Executors and driver must share it, so there is no fallback to a local folder: without the
    setting, and without ``use_folder``, this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _NAMED.get("folder")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> bool:
    """Delete every intermediate table of this application, once no DataFrame reads them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared root; nothing is ever overwritten."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage at a table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
