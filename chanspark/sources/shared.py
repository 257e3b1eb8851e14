"""The folder that driver and executors share, and folders in it."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI that spark.checkpoint.dir names; where it is unset, a local session gets a temporary folder, and a cluster an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chanspark-")
        context.setCheckpointDir(found)
    if ":/" not in found:
        found = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + "/" + found.lstrip("/")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder that doesn't exist yet."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    """In any file system that Spark can reach."""
    fs, path = _path(spark, uri)
    return fs.exists(path)


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _path(spark, uri)
    fs.delete(path, True)
