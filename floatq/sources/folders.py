"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Only used on a local master when the session names no folder.
LOCAL_DIR = "/tmp/checkpoints/floatq-local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a session on a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that goes when the JVM ends."""
    name = f"{shared_dir(spark)}/floatq-{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name
