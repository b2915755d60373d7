"""Written intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests)
a temporary folder of this machine is used, which goes when the process ends; on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder name below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-quern-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    The files survive the loss of any executor, unlike a cached frame.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir() named, when nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
