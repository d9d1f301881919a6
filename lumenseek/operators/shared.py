"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a local session gets a temporary folder, recorded in the session; on a cluster
    that is an error, as each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenseek-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{folder(spark)}/lumenseek/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """What opens a path, and the path there: any address that pyarrow knows, or a plain local path."""
    return fs.FileSystem.from_uri(path) if path.split("/", 1)[0].endswith(":") else (fs.LocalFileSystem(), path)
